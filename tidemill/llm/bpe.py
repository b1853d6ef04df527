"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold the rank of each adjacent pair, the root the leftmost pair of the
lowest rank. A merge rewrites at most three leaves, each in logarithmic time, until the root
shows no mergeable pair. Ids equal those of the tokenizers library for the same file.

Defined cases: null counts as empty and has no ids; white-space and very long texts go through
the same tree, whole; of equal ranks the leftmost pair merges first; the string of a special token
is that token; repeated rows are encoded each; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidemill.llm.common import map_rows, no_cycles, table

#: Encoded chunks kept in each of two generations, and the longest chunk kept.
CACHE_ROWS, CACHE_CHARS = 300_000, 48

_NONE = 1 << 62
NO_RANK = 1 << 40
#: Slots of the pair table, and how a pair's key is mixed into one.
_SLOTS, _MIX, _SHIFT = 1 << 19, np.int64(0x1E3779B97F4A7C15), np.int64(40)
#: Bytes of the longest pre-token whose tree advances together with others.
_TOGETHER = 128
#: Characters of the texts that are encoded at a time.
_AT_ONCE = 1 << 20
# White space as Unicode has it; Python's \s also takes four control characters.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ODD_SPACE = re.compile(r" \s| \Z")
_CHUNK = re.compile(r"(?= \S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes as."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for text, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.byte_ids = np.array(self.byte, np.int64)
        self._pair_table()
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)

    def _pair_table(self) -> None:
        """The merges by pair in a table of slots; pairs whose slot is taken are kept sorted."""
        pairs = [((k >> 32) << 20 | (k & 0xFFFFFFFF), rank, new) for k, (rank, new) in self.merge.items()]
        self.merged_id = np.array([p[2] for p in pairs] or [0], np.int64)
        self.slot_key, self.slot_rank = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, NO_RANK, np.int64)
        self.slot_more = np.zeros(_SLOTS, bool)
        more = []
        for key, rank, _ in pairs:
            slot = (((key * int(_MIX)) & (2**64 - 1)) >> int(_SHIFT)) & (_SLOTS - 1)
            if self.slot_key[slot] < 0:
                self.slot_key[slot], self.slot_rank[slot] = key, rank
            else:
                self.slot_more[slot] = True
                more.append((key, rank))
        more.sort()
        self.more_key = np.array([m[0] for m in more] or [-2], np.int64)
        self.more_rank = np.array([m[1] for m in more] or [NO_RANK], np.int64)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte[b] for b in piece]
        n = len(ids)
        if n == 1:
            return ids
        get, bits = self.merge.get, n.bit_length()
        base = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_NONE] * (2 * base)
        for i in range(n - 1):
            if m := get(ids[i] << 32 | ids[i + 1]):
                tree[base + i] = m[0] << bits | i
        for i in range(base - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << bits) - 1
        while (low := tree[1]) != _NONE:
            i = low & mask
            j = after[i]
            ids[i] = get(ids[i] << 32 | ids[j])[1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            todo = [(i, get(ids[i] << 32 | ids[k]) if k < n else None)]
            if j < n - 1:
                todo.append((j, None))
            if (h := before[i]) >= 0:
                todo.append((h, get(ids[h] << 32 | ids[i])))
            for at, m in todo:
                value = m[0] << bits | at if m else _NONE
                at += base
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    if other < value:
                        value = other
                    at >>= 1
                    if tree[at] == value:
                        break
                    tree[at] = value
        return [i for i in ids if i >= 0]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK where there is no merge; a right id below 0 has none."""
        key = left << 20 | right
        slot = (key * _MIX) >> _SHIFT & (_SLOTS - 1)
        rank = np.where(self.slot_key[slot] == key, self.slot_rank[slot], NO_RANK)
        odd = np.flatnonzero(self.slot_more[slot] & (rank == NO_RANK) & (right >= 0))
        if len(odd):
            at = np.minimum(np.searchsorted(self.more_key, key[odd]), len(self.more_key) - 1)
            rank[odd] = np.where(self.more_key[at] == key[odd], self.more_rank[at], NO_RANK)
        return rank

    def merged_many(self, pieces: list[bytes]) -> list[bytes]:
        """merged() of many pre-tokens, packed: their trees advance together, a merge a round."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            n = len(piece)
            if n > _TOGETHER:
                out[i] = np.array(self.merged(piece), "<u4").tobytes()
            else:
                by_size.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(i)
        for size, at in by_size.items():
            for i, packed in zip(at, self._trees([pieces[i] for i in at], size), strict=True):
                out[i] = packed
        return out

    def _trees(self, pieces: list[bytes], size: int) -> list[bytes]:
        """A tree of `size` leaves for each piece, a row each; the last leaf is never a pair."""
        n, width = len(pieces), size + 1
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        ids = np.full((n, width), -1, np.int64)
        ids[:, :size] = np.where(np.arange(size) < lengths[:, None], self.byte_ids[raw], -1)
        after = np.where(np.arange(1, width + 1) < lengths[:, None], np.arange(1, width + 1), size)
        before = np.tile(np.arange(-1, size), (n, 1))
        tree = np.full((n, 2 * size), _NONE, np.int64)
        rank = self.lookup(ids[:, : size - 1].ravel(), ids[:, 1:size].ravel()).reshape(n, size - 1)
        tree[:, size : 2 * size - 1] = np.where(rank == NO_RANK, _NONE, rank << 8 | np.arange(size - 1))
        level = size // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        ids_, after_, before_, tree_ = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            low = tree_[rows * (2 * size) + 1]
            rows, low = rows[low != _NONE], low[low != _NONE]
            if not len(rows):
                break
            own, top = rows * width, rows * (2 * size)
            i = low & 255
            new = self.merged_id[low >> 8]
            j = after_[own + i]
            k = after_[own + j]
            h = before_[own + i]
            ids_[own + i], ids_[own + j] = new, -1
            after_[own + i], before_[own + k] = k, i
            some = h >= 0
            left = np.where(some, h, size - 1)
            right_rank = self.lookup(new, ids_[own + k])
            left_rank = np.where(some, self.lookup(np.where(some, ids_[own + left], 0), new), NO_RANK)
            tree_[top + size + j] = _NONE
            tree_[top + size + i] = np.where(right_rank == NO_RANK, _NONE, right_rank << 8 | i)
            tree_[top + size + left] = np.where(left_rank == NO_RANK, _NONE, left_rank << 8 | left)
            for leaf in (j, i, left):
                at = (size + leaf) >> 1
                while True:
                    node = top + 2 * at
                    tree_[top + at] = np.minimum(tree_[node], tree_[node + 1])
                    if at[0] == 1:
                        break
                    at = at >> 1
        kept = ids[:, :size] >= 0
        flat = ids[:, :size][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks that are in no cache."""
        parts = [(c, _pieces(c)) for c in chunks if c not in self.special]
        if len(self.words) >= CACHE_ROWS:
            self.words = {}
        words = self.words
        new = list({p for _, pieces in parts for p in pieces if p not in words})
        words.update(zip(new, self.merged_many([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        young = self.young
        for c in chunks & self.special.keys():
            young[c] = np.array([self.special[c]], "<u4").tobytes()
        for c, pieces in parts:
            young[c] = words[pieces[0]] if len(pieces) == 1 else b"".join([words[p] for p in pieces])
        for p in new:
            if len(p) > CACHE_CHARS:
                del words[p]

    def packed_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        with no_cycles():
            return self._packed_many(texts)

    def _packed_many(self, texts: list[str]) -> list[bytes]:
        if len(self.young) >= CACHE_ROWS:
            self.old, self.young = self.young, {}
        split = [self._chunks(t) for t in texts]
        young, old = self.young, self.old
        missing = set().union(*split) - young.keys()
        young.update((c, old[c]) for c in missing & old.keys())
        missing -= young.keys()
        if missing:
            self.learn(missing)
        get = young.__getitem__
        out = [b"".join(map(get, parts)) for parts in split]
        for c in [c for c in missing if len(c) > CACHE_CHARS]:
            del young[c]
        return out

    def _chunks(self, text: str) -> list[str]:
        if self.stops and any(s in text for s in self.special):
            return [c for k, p in enumerate(self.stops.split(text)) for c in ([p] if k % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        """Chunks that begin where a pre-token begins: a single space before other text does."""
        if not text:
            return []
        return [c for c in _CHUNK.split(text) if c] if _ODD_SPACE.search(text) else _simple(text)

    def packed(self, text: str) -> bytes:
        return self.packed_many([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text or ""), "<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.flat[at].tobytes()

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def _simple(text: str) -> list[str]:
    """Chunks of a text whose spaces all stand alone before other characters."""
    first, *rest = text.split(" ")
    out = [" " + c for c in rest]
    if first:
        out.insert(0, first)
    return out


def _pieces(chunk: str) -> list[str]:
    """Pre-tokens of a chunk; the first lines are short cuts for what the pattern would give."""
    own = chunk[1:] if chunk[:1] == " " else chunk
    if own.isalpha():
        return [chunk]
    if own[-1:] in _MARKS and own[:-1].isalpha():
        return [chunk[:-1], own[-1]]
    return _SPLIT.findall(chunk)


_MARKS = tuple(".,;:!?|")

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per process and file."""
    path = path or default_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded_rows(enc: Encoder, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, packed ids) of (key, text) rows, encoded a few at a time."""
    keys, texts, size = [], [], 0
    for i, text in rows:
        keys.append(i)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= _AT_ONCE:
            yield from zip(keys, enc.packed_many(texts), strict=True)
            keys, texts, size = [], [], 0
    yield from zip(keys, enc.packed_many(texts), strict=True)


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id, n_tokens, and digests of the ids and of the decoded text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        enc = encoder(path)
        for i, packed in encoded_rows(enc, rows):
            ids = np.frombuffer(packed, "<u4").astype(np.int64)
            back = enc.decode(ids).encode("utf-8", "surrogatepass")
            yield i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) for callers that want the ids themselves."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        enc = encoder(path)
        for i, packed in encoded_rows(enc, rows):
            yield i, np.frombuffer(packed, "<u4").tolist()

    return map_rows(docs, [id_col, text_col], run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) from ids; null ids give an empty text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        enc = encoder(path)
        for i, ids in rows:
            yield i, enc.decode(ids or [])

    return map_rows(encoded, [id_col, ids_col], run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
