"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All words of a batch lie in one flat array of symbols. A round finds each word's lowest rank of
adjacent pairs by a segmented minimum, merges the leftmost pairs of that rank in all words at
once, and compacts the arrays; words without a pair that merges leave. Within a word, occurrences
merge together only as far as the sequential order would take them: up to and with the first whose
merge makes a new pair of no higher rank, which then comes first in the next round. Ids and decoded
text equal those of the sentencepiece library for the same model.

A word is a run of spaces and the characters up to the next one: no piece of such a model goes
from a character to a space, so no merge leaves a word. A model that has such a piece is read as
one word a text.

Defined cases: null counts as empty and has no ids; empty text has no ids and no prefix; spaces
are kept one by one; characters outside the vocabulary become their bytes; of equal ranks the
leftmost pair merges first; very long texts are encoded whole, in time that for one word grows with
its length times the number of ranks in it; repeated rows are encoded each; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tidemill.llm.common import map_rows, no_cycles, table

#: Encoded words kept in each of two generations, and the longest word kept.
CACHE_ROWS, CACHE_CHARS = 300_000, 48
#: Characters of the texts that are encoded at a time.
_AT_ONCE = 1 << 20

NO_RANK = np.int64(1 << 40)
_SLOTS, _MIX, _SHIFT = 1 << 20, np.int64(0x1E3779B97F4A7C15), np.int64(40)
SPACE = "▁"
_ODD_SPACE = re.compile(r"  | \Z|\A |\A\Z")
_WORD = re.compile(r" +[^ ]*|[^ ]+")

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm, kinds = model.trainer_spec, model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if spec.model_type != 2 or not spec.byte_fallback or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and spaces before words are read")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models that keep characters and spaces as they are, with one space before the text, are read")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = np.zeros(256, np.int64)
        text = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                text[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == kinds.CONTROL:
                text[i] = b""
            elif p.type == kinds.UNKNOWN:
                text[i] = spec.unk_surface.encode()
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.spaced = np.array([p.piece.startswith(SPACE) and p.type == kinds.NORMAL for p in model.pieces])
        self.silent = np.array([p.type == kinds.CONTROL for p in model.pieces])
        # Characters of pieces that are no pieces themselves get numbers of their own after the ids.
        self.size = len(model.pieces)
        self.symbols = dict(normal)
        for c in sorted({c for p in normal for c in p} - normal.keys()):
            self.symbols[c] = self.size + len(self.symbols) - len(normal)
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self._pair_table([(a, b, rank[model.pieces[i].score], i) for p, i in normal.items() for a, b in self._splits(p)])
        self.whole = any(SPACE in p.lstrip(SPACE) for p in normal)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # A long run of spaces gives this many to a piece again and again; 0 if it does not.
        longest = max(len(p) for p in [SPACE, *normal] if not p.strip(SPACE))
        run = self._merged([SPACE * (6 * longest)])[0] if SPACE in normal else b""
        self.run = longest if longest > 1 and len(run) == 4 * 6 else 0
        shown = [b"%d," % i for i in range(self.size)]
        self.digits = np.array([len(d) for d in shown], np.int64)
        self.digit_starts, self.digit_flat = np.cumsum(self.digits) - self.digits, np.frombuffer(b"".join(shown), np.uint8)

    def _splits(self, piece: str) -> Iterator[tuple[int, int]]:
        for k in range(1, len(piece)):
            if piece[:k] in self.symbols and piece[k:] in self.symbols:
                yield self.symbols[piece[:k]], self.symbols[piece[k:]]

    def _pair_table(self, pairs: list[tuple[int, int, int, int]]) -> None:
        """Rank and merged id by pair, in slots of a table; pairs whose slot is taken are kept sorted."""
        n = len(pairs)
        a, b, rank, new = np.array(pairs or [(0, 0, 0, 0)], np.int64).T
        key = a << 20 | b
        slot = self._slot(key)
        first = np.unique(slot, return_index=True)[1]
        self.slot_key, self.slot_value = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, -1, np.int64)
        self.slot_more = np.zeros(_SLOTS, bool)
        value = rank << 20 | new
        if n:
            self.slot_key[slot[first]], self.slot_value[slot[first]] = key[first], value[first]
        rest = np.setdiff1d(np.arange(n), first)
        self.slot_more[slot[rest]] = True
        rest = rest[np.argsort(key[rest])]
        self.more_key, self.more_value = np.append(key[rest], 1 << 62), np.append(value[rest], -1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * _MIX) >> _SHIFT & (_SLOTS - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of pairs, NO_RANK << 20 where there is no merge; an id below 0 has none."""
        key = np.where((left < 0) | (right < 0), -2, left << 20 | right)
        slot = self._slot(key)
        value = np.where(self.slot_key[slot] == key, self.slot_value[slot], NO_RANK << 20)
        odd = np.flatnonzero(self.slot_more[slot] & (self.slot_key[slot] != key))
        if len(odd):
            at = np.searchsorted(self.more_key, key[odd])
            value[odd] = np.where(self.more_key[at] == key[odd], self.more_value[at], NO_RANK << 20)
        return value

    def _merged(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word, which has its spaces as SPACE."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym, word = self.of_char[chars], np.repeat(np.arange(len(words)), lengths)
        code, none = chars.astype(np.int64), NO_RANK << 20
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        value = np.full(len(sym), none)
        value[:-1] = np.where(word[:-1] == word[1:], self.lookup(sym[:-1], sym[1:]), none)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            nth = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(word)]))
            rank = value >> 20
            low = np.minimum.reduceat(rank, starts)
            over = (low == NO_RANK)[nth]
            if over.any():
                done.append((word[over], sym[over], code[over]))
                sym, word, code, value, nth, rank = (x[~over] for x in (sym, word, code, value, nth, rank))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low[nth])
            # Of pairs that overlap one another every second one, from the left.
            fresh = np.r_[True, np.diff(at) != 1]
            begun = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begun) % 2 == 0]
            new, own = value[at] & 0xFFFFF, rank[at]
            # The pairs that a merge makes when all before it in its word are made.
            beside = np.r_[False, at[1:] == at[:-1] + 2]
            before = np.where(beside, np.r_[-1, new[:-1]], sym[at - 1])
            before = np.where((at > 0) & (word[at - 1] == word[at]), before, -1)
            after = np.minimum(at + 2, len(sym) - 1)
            behind = np.where((at + 2 < len(sym)) & (word[after] == word[at]), sym[after], -1)
            stop = np.minimum(self.lookup(before, new), self.lookup(new, behind)) >> 20 <= own
            # Up to and with the first of each word that must be followed up.
            stops = np.cumsum(stop) - stop
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            base = np.maximum.accumulate(np.where(first, stops, 0))
            at, new = at[stops == base], new[stops == base]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym[at], code[at] = new, -1
            place = np.cumsum(keep)[at] - 1
            sym, word, code, value = (x[keep] for x in (sym, word, code, value))
            for p in (place, place[place > 0] - 1):
                q = np.minimum(p + 1, len(sym) - 1)
                value[p] = np.where((p + 1 < len(sym)) & (word[q] == word[p]), self.lookup(sym[p], sym[q]), none)
        return self._packed(done, len(words))

    def _packed(self, done: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> list[bytes]:
        """Ids of finished words, packed; symbols that are no pieces become the bytes of their character."""
        if not done:
            return [b""] * n
        word, sym, code = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, sym, code = word[order], sym[order], code[order]
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(odd):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[odd].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(b) for b in raw]
            is_odd = np.zeros(len(sym), bool)
            is_odd[odd] = True
            word, sym, at = np.repeat(word, times), np.repeat(sym, times), np.repeat(is_odd, times)
            sym[at] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        flat = sym.astype("<u4").tobytes()
        ends = (4 * np.searchsorted(word, np.arange(1, n + 1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are in no cache."""
        spaced = [w.replace(" ", SPACE) for w in words]
        sure: dict[int, int] = {}  # how many pieces of spaces a word is sure to begin with, whatever follows
        for k, w in enumerate(spaced):
            if self.run and len(w) > 4 * self.run and (n := (len(w) - len(w.lstrip(SPACE))) // self.run) > 2:
                sure[k], spaced[k] = n - 2, w[(n - 2) * self.run :]
        self.young.update(zip(words, self._merged(spaced), strict=True))
        for k, n in sure.items():
            self.young[words[k]] = np.full(n, self.symbols[SPACE * self.run], "<u4").tobytes() + self.young[words[k]]

    def words(self, text: str) -> list[str]:
        """The words of a text, with the space before it; none of an empty text."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.whole:
            return [" " + text] if text else []
        return _WORD.findall(" " + text) if text and _ODD_SPACE.search(text) else [" " + w for w in text.split(" ")] if text else []

    def packed_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        with no_cycles():
            if len(self.young) >= CACHE_ROWS:
                self.old, self.young = self.young, {}
            split = [self.words(t) for t in texts]
            young, old = self.young, self.old
            missing = set().union(*split) - young.keys()
            young.update((w, old[w]) for w in missing & old.keys())
            missing -= young.keys()
            if missing:
                self.learn(list(missing))
            get = young.__getitem__
            out = [b"".join(map(get, words)) for words in split]
            for w in [w for w in missing if len(w) > CACHE_CHARS]:
                del young[w]
            return out

    def decimals(self, ids: np.ndarray) -> bytes:
        """Ids as decimals joined by commas."""
        return _gathered(self.digit_flat, self.digit_starts[ids], self.digits[ids])[:-1]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed_many([text or ""])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        """The text of ids without the space before it; each byte that is no UTF-8 becomes one replacement character."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        quiet = np.flatnonzero(self.silent[ids])  # controls have no text, and end a run of bytes
        if len(quiet):
            parts = [p[1:] if len(p) and self.silent[p[0]] else p for p in np.split(ids, quiet)]
            return "".join(self._text(p, k == 0) for k, p in enumerate(p for p in parts if len(p)))
        return self._text(ids, True)

    def _text(self, ids: np.ndarray, first: bool) -> str:
        raw = _gathered(self.flat, self.starts[ids], self.lengths[ids])
        return raw[1 if first and self.spaced[ids[0]] else 0 :].decode("utf-8", "each_byte")


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """The stretches of flat that begin and are as long as given, one after the other."""
    if not len(starts):
        return b""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)].tobytes()


_MODELS: dict[str, Pieces] = {}


def pieces(path: str | None = None) -> Pieces:
    """One model per process and file."""
    path = path or default_path()
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encoded_rows(model: Pieces, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, packed ids) of (key, text) rows, encoded a few at a time."""
    keys, texts, size = [], [], 0
    for i, text in rows:
        keys.append(i)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= _AT_ONCE:
            yield from zip(keys, model.packed_many(texts), strict=True)
            keys, texts, size = [], [], 0
    yield from zip(keys, model.packed_many(texts), strict=True)


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id, n_tokens, and digests of the ids and of the decoded text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        model = pieces(path)
        for i, packed in encoded_rows(model, rows):
            ids = np.frombuffer(packed, "<u4").astype(np.int64)
            back = model.decode(ids).encode("utf-8", "surrogatepass")
            yield i, len(ids), hashlib.sha256(model.decimals(ids)).hexdigest(), hashlib.sha256(back).hexdigest()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) for callers that want the ids themselves."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, packed in encoded_rows(pieces(path), rows):
            yield i, np.frombuffer(packed, "<u4").tolist()

    return map_rows(docs, [id_col, text_col], run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) from ids; null ids give an empty text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        model = pieces(path)
        for i, ids in rows:
            yield i, model.decode(ids or [])

    return map_rows(encoded, [id_col, ids_col], run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
