"""Table schemas. Absent facts are null, never 0; unknown extra fields of a source are ignored."""

from __future__ import annotations

from pyspark.sql.types import StructType

_BALL = "array<struct<frame_index:int,t_seconds:double,x:double,y:double,radius:double,observed:boolean>>"

DDL: dict[str, str] = {
    "jobs": "schema_version int, job_id string, match_id string, season int, video_id string, capture_mode string, local_path string,"
    " start_offset double, duration double, fps double, width int, height int, status string, stage string, progress double, error_code string,"
    " error string, attempt int, created_at timestamp, updated_at timestamp, alliances struct<red:array<int>,blue:array<int>>, tba_score struct<red:int,blue:int>",
    "events": "schema_version int, job_id string, match_id string, event_id string, team int, track_id int, t_seconds double, phase string,"
    " event_type string, confidence double, field_x double, field_y double, goal string, source string",
    "tracks": "schema_version int, job_id string, match_id string, track_id int, robot_name string, raw_track_ids array<int>, merged_track_ids array<int>,"
    " identity_status string, identity_issues array<string>, team int, alliance string, position_source string, team_confidence double,"
    " boxes array<struct<t:double,x:double,y:double,w:double,h:double,field_x:double,field_y:double,velocity_x_ftps:double,velocity_y_ftps:double,speed_ftps:double,motion_heading_rad:double>>,"
    " gaps array<struct<start:double,end:double,reason:string>>",
    "corrections": "schema_version int, correction_id string, scope string, job_id string, target_id string, match_id string, action string,"
    " fields map<string,string>, created_at timestamp, created_by string",
    "shots": "schema_version int, job_id string, shot_id string, launch_frame int, launch_t_seconds double, robot_track_id int, ball_track_id int, confidence double,"
    f" attribution_confidence double, outcome string, goal string, outcome_frame int, outcome_t_seconds double, coordinate_space string, ball_track {_BALL}",
    "goal_entries": "schema_version int, job_id string, entry_id string, goal string, region_id string, ball_track_id int, frame_index int, t_seconds double,"
    " crossing_frame int, crossing_t_seconds double, confidence double, shot_id string, robot_track_id int, association string,"
    f" association_confidence double, coordinate_space string, ball_track {_BALL}",
    "raw_tracklets": "schema_version int, job_id string, fragment_id int, raw_track_id int,"
    " boxes array<struct<t:double,x:double,y:double,w:double,h:double,confidence:double,alliance:string,stable_track_id:int>>",
    "samples": "job_id string, match_id string, robot_key string, team int, alliance string, t double, mt double, phase string,"
    " x double, y double, ax double, ay double, speed double, zone string, lane string",
    "launches": "job_id string, match_id string, robot_key string, team int, shot_id string, t double, mt double, phase string, ax double, ay double, speed double, confidence double",
    "clock_readings": "job_id string, t double, remaining int",
    "score_readings": "job_id string, alliance string, t double, value int",
    "ocr_reads": "job_id string, track_id int, alliance string, read string",
    "proposals": "frame_id string, source string, x double, y double, w double, h double, confidence double",
    "seasons": "season int, auto_seconds double, teleop_seconds double, endgame_seconds double, transition_seconds double, field_length_ft double, field_width_ft double,"
    " goals array<string>, point_values map<string,map<string,int>>",
    "geometry": "season int, field_length_ft double, field_width_ft double, zones array<struct<id:string,x_min:double,x_max:double>>,"
    " lanes array<struct<id:string,y_min:double,y_max:double>>, hub_x double, hub_y double",
}


def schema(table: str) -> StructType:
    """The schema of a table by name."""
    return StructType.fromDDL(DDL[table])


def drift(live: StructType, table: str) -> dict[str, list[str]]:
    """Columns that a live table lacks or has beyond its schema."""
    declared, have = {f.name for f in schema(table)}, {f.name for f in live}
    return {"missing": sorted(declared - have), "extra": sorted(have - declared)}
