"""BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A word starts as its byte symbols, the last one marked as word end. The leaves of the tree hold, for each symbol
that still starts a pair, the pair's rank; each inner node holds the smaller of its children and, on a tie, the
left one. The root therefore names the leftmost pair of lowest rank. Merging it changes at most two neighbouring
pairs and removes one, which are three leaf updates of logarithmic cost. Encoding ends when the root is empty.

The leaves and inner nodes carry the place with the rank, which makes the root's minimum the leftmost one.

Text is cut at ASCII white space first, which neither normalisation nor the splitting pattern nor a special token
crosses; plain words are cut further by the pattern. Such a part of a text always encodes alike, and a bounded
cache per Python worker serves repeated ones. That holds for the normaliser and pattern stated below; the whole texts
of a vocabulary file with others go through the library's normaliser and splitter before the tree. A file whose merges
need more than ranks (unknown tokens, dropout, prefixes, byte fallback) is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Cached parts of texts of one worker, and the length above which a part isn't kept; a full cache starts anew.
CACHE_PARTS, LONG_PART = 500_000, 256
#: Longer texts are encoded in pieces of about so many characters, cut at white space.
PIECE_CHARS = 1 << 20
#: Texts of visible ASCII, Latin-1 letters and ASCII white space are their own normal form, and in lower case this is
#: how the vocabulary file's pattern cuts them; other words go through the library's normaliser and splitter.
_PLAIN = re.compile(r"[!-~¡¿À-ÖØ-öø-ÿ \t\n\r\x0b\x0c]+").fullmatch
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t\n\r\x0b\x0c]+").findall
_SPACES = re.compile(r"[ \t\n\r\x0b\x0c]")
#: The rules of a vocabulary file that the two patterns above and the cuts at white space stand for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Settings of a model or an added token that the merges here know only as unset.
UNSET_MODEL = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
UNSET_TOKEN = ("single_word", "lstrip", "rstrip", "normalized")
RAW = "\0"
NONE = 1 << 62
#: A leaf is ``rank << PLACE_BITS | place``, so the smallest is the leftmost pair of lowest rank.
PLACE_BITS = 32
PLACE = (1 << PLACE_BITS) - 1


class PairTree:
    """Smallest leaf under point updates; ``tree[1]`` is the root."""

    def __init__(self, leaves: list[int]):
        size = 1
        while size < len(leaves):
            size *= 2
        level = leaves + [NONE] * (size - len(leaves))
        levels = [level]
        while len(level) > 1:
            level = [a if a < b else b for a, b in zip(level[::2], level[1::2])]
            levels.append(level)
        self.size = size
        self.tree = [NONE]
        for level in reversed(levels):
            self.tree += level

    def update(self, place: int, leaf: int) -> None:
        tree, i = self.tree, self.size + place
        tree[i] = leaf
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least


def cuts_alike(data: dict) -> bool:
    """Whether a vocabulary file has the rules under which parts of texts encode alone."""
    return data.get("normalizer") == NORMALIZER and data.get("pre_tokenizer") == SPLITTER and bool(data["model"].get("end_of_word_suffix")) and not data.get("decoder")


class WordBpe:
    """A vocabulary file with ranked merges, byte symbols and a word-end mark."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        odd = [k for k in UNSET_MODEL if model.get(k)] + [k for k in UNSET_TOKEN if any(t.get(k) for t in data["added_tokens"])]
        if odd or model["type"] != "BPE":
            raise ValueError(f"not a vocabulary of plain ranked merges: {model['type']}, {', '.join(odd)}")
        self.cuts_alike = cuts_alike(data)
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.numbers = [str(i) for i in range(len(self.names))]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.top = len(self.names)
        self.ranked = {self.vocab[a] * self.top + self.vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        built = Tokenizer.from_str(spec)
        self.library = built if data.get("decoder") else None
        self.normalizer: normalizers.Normalizer = built.normalizer or normalizers.Sequence([])
        self.splitter: pre_tokenizers.PreTokenizer = built.pre_tokenizer or pre_tokenizers.Sequence([])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = {c: "".join(p for p, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))) for c in [0xA1, 0xBF, *range(0xC0, 0x100)]}
        self.parts: dict[str, tuple[int, ...]] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """Apply merges, lowest rank first and leftmost first, until none applies."""
        n, get, top = len(symbols), self.ranked.get, self.top
        leaves = [hit << PLACE_BITS | i if (hit := get(a * top + b)) is not None else NONE for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        if not leaves:
            return symbols
        pairs = PairTree(leaves)
        tree, update, made = pairs.tree, pairs.update, self.made
        ids, after, before = symbols, list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != NONE:
            i = root & PLACE
            ids[i] = whole = made[root >> PLACE_BITS]
            j = after[i]
            k = after[i] = after[j]
            ids[j] = -1
            if k < n:
                before[k] = i
                update(j, NONE)
                hit = get(whole * top + ids[k])
                update(i, NONE if hit is None else hit << PLACE_BITS | i)
            else:
                update(i, NONE)
            h = before[i]
            if h >= 0:
                hit = get(ids[h] * top + whole)
                update(h, NONE if hit is None else hit << PLACE_BITS | h)
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece of the splitting pattern, in byte symbols."""
        vocab = self.vocab
        try:
            return self.merged([*map(vocab.__getitem__, piece[:-1]), vocab[piece[-1] + self.end]])
        except KeyError:
            found = [*map(vocab.get, piece[:-1]), vocab.get(piece[-1] + self.end)]
            return self.merged([x for x in found if x is not None])

    def part(self, part: str) -> tuple[int, ...]:
        """Ids of a part of a text as ``parts_of`` gives it."""
        if part[0] != RAW:
            return tuple(self.piece(part if part.isascii() else part.translate(self.bytes)))
        out: list[int] = []
        for text in self.cut.split(part[1:]) if self.cut else (part[1:],):
            if text in self.special:
                out.append(self.special[text])
            elif text:
                for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)):
                    out.extend(self.piece(piece))
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, special tokens only where the text spells them."""
        if not self.cuts_alike:
            return [*self.part(RAW + text)] if text else []
        known, parts = self.parts, parts_of(text)
        if len(known) >= CACHE_PARTS:
            known.clear()
        long = []
        for part in set(parts):
            if part not in known:
                known[part] = self.part(part)
                if len(part) > LONG_PART:
                    long.append(part)
        ids = [*chain.from_iterable(map(known.__getitem__, parts))]
        for part in long:
            del known[part]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by one space, as a file without a decoder asks for; special tokens stay.

        Ids outside the vocabulary are passed over. A file with a decoder uses the library's.
        """
        if self.library:
            return self.library.decode(list(ids), skip_special_tokens=False)
        names = self.names
        return " ".join([names[i] for i in ids if 0 <= i < len(names) and names[i] is not None])


def parts_of(text: str) -> list[str]:
    """What encodes alone and is cached: pieces of the splitting pattern, or whole words, marked, where they are not plain."""
    if _PLAIN(text) and "<" not in text:
        return _PIECES(text.lower())
    out: list[str] = []
    for word in _SPACES.split(text):
        if not word:
            continue
        if _PLAIN(word) and "<" not in word:
            out.extend(_PIECES(word.lower()))
        else:
            out.append(RAW + word)
    return out


def pieces_of(text: str, alike: bool = True) -> Iterator[str]:
    """The text in parts of about PIECE_CHARS characters, cut at white space where there is any; whole if parts do not encode alike."""
    if not alike:
        yield text
        return
    lo = 0
    while lo < len(text):
        found = _SPACES.search(text, lo + PIECE_CHARS)
        hi = found.start() if found else len(text)
        yield text[lo:hi]
        lo = hi


@cache
def _tokenizer(spec: str) -> WordBpe:
    return WordBpe(spec)


def load_spec(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read on the driver; its size is that of one vocabulary, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row; null and empty texts have no ids. Other columns are ignored."""
    spec = load_spec(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give the empty text."""
    spec = load_spec(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [bpe.decode([i for i in ids or () if i is not None]) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, str] | None = None, with_ids: bool = True, keep: bool = True) -> DataFrame:
    """Encode every text, decode its ids again, and return ``doc_id, n_tokens, ids_sha256, decoded_sha256, ids``.

    The digests are those of the decimal ids joined by one space and of the decoded text in UTF-8. Both are fed
    part by part, so that without ``with_ids`` a very long text never has all its ids in memory. ``carry`` names long
    columns that go along, before the others, by their new names. Null and empty texts have no ids, and both digests
    are those of nothing; repeated rows get a row each; an empty table gives no rows. Other columns are ignored,
    whatever their names. Without ``keep``, a worker's cache of parts goes with the task that filled it.
    """
    spec, carry = load_spec(docs.sparkSession, vocabulary), carry or {}
    n = len(carry)
    names = [*carry, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        numbers = bpe.numbers
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                rows = batch.slice(lo, 1024)
                n_tokens, of_ids, of_text, all_ids = [], [], [], []
                for value in rows.column(n + 1):
                    ids_sha, text_sha, count, own = hashlib.sha256(), hashlib.sha256(), 0, array("i")
                    for part in pieces_of(value.as_py() or "", bpe.cuts_alike):
                        if ids := bpe.encode(part):
                            gap = " " if count else ""
                            ids_sha.update((gap + " ".join([numbers[i] for i in ids])).encode())
                            text_sha.update((gap + bpe.decode(ids)).encode())
                            count += len(ids)
                            if with_ids:
                                own.extend(ids)
                    n_tokens.append(count), of_ids.append(ids_sha.hexdigest()), of_text.append(text_sha.hexdigest()), all_ids.append(own)
                made = [pa.array(n_tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                if with_ids:
                    ends = pa.array([0, *accumulate(n_tokens)], pa.int32())
                    joined = array("i")
                    for own in all_ids:
                        joined += own
                    made.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(joined, dtype=np.int32) if joined else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays([*rows.columns[: n + 1], *made], names=names)
        if not keep:
            bpe.parts.clear()

    rows = docs.select(*[F.col(c).cast("long").alias(name) for name, c in carry.items()], F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [*["long"] * (n + 2), "string", "string", *["array<int>"] * with_ids]
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds, strict=True)))


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`tokens` without the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return tokens(docs, vocabulary, id_col, text_col, with_ids=False)
