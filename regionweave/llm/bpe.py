"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its incremental decoder.

A merge list decides how far ahead a token can still change. `MergeTable.lookahead` computes a sufficient distance from the list itself: a token is stable once that many further symbols are known, because no chain of higher-priority merges can reach back over it. `StreamingEncoder` therefore holds a bounded window of symbols, emits what is stable, and forgets it. Every pre-token goes through it, CHUNK characters at a time; the end of a pre-token makes the rest stable, so short ones leave at their end. Texts are walked CHUNK characters at a time, ids are decoded one by one and hashed in blocks of BLOCK_WORDS words. So beyond the text itself (and the normalised copy of the characters taken at once, or of one longer word) memory does not grow with a text; only `encode` and `tokens_frame`, whose result is the list of ids, hold all of them.

Words of up to CACHE_CHARS characters are remembered with the ids that the transducer gave them.

Null texts count as empty and give no tokens. Extra columns pass through `encode_frame`; the others read only theirs. Equal rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import give_back, portions, table

#: Pre-tokens of the vocabulary file: contractions, letters, one number, other symbols.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: str.split() also parts at these, which are not white space to the vocabulary's normaliser.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"\p{White_Space}+")
#: Distinct words and pre-tokens in each of the two generations that a task keeps; both are emptied when the task ends, so idle workers hold none.
CACHE_WORDS = 150_000
#: Words longer than this bypass the cache, so that its size is bounded in bytes too.
CACHE_CHARS = 64
#: Words whose ids are decoded and hashed together; characters of a text or of a pre-token that are taken at once.
BLOCK_WORDS, CHUNK = 4096, 1 << 16


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


BYTE_SYMBOL = _byte_symbols()
SYMBOL_BYTE = {c: b for b, c in enumerate(BYTE_SYMBOL)}


class MergeTable:
    """Vocabulary and ranked merges of one vocabulary file, with the lookahead that they need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        self.surface = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.lookahead = self._lookahead(pairs)
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def width(self, token: str) -> int:
        """Symbols (bytes) that a token covers; the end-of-word mark belongs to the last symbol."""
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) and token != self.suffix else 0)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols after a token's end within which every merge that could change it is decided.

        Rule i = (u, v) needs, beyond the end of v, whatever an earlier rule (x, w) needs that could first consume a
        right end x of v: the width of w and w's own need. One pass in rank order carries the largest need by left part.
        A token that several rules make has the right ends of all of them.
        """
        parts: dict[str, list[str]] = {}
        for left, right in pairs:
            parts.setdefault(left + right, []).append(right)
        by_left: dict[str, int] = {}

        def need(token: str) -> int:
            most, todo, seen = 0, [token], {token}
            while todo:
                t = todo.pop()
                most = max(most, by_left.get(t, 0))
                new = [r for r in parts.get(t, ()) if r not in seen]
                seen.update(new)
                todo += new
            return most

        for left, right in pairs:
            by_left[left] = max(by_left.get(left, 0), self.width(right) + need(right))
        return max([need(t) for t in {*parts, *by_left}], default=0)

    def symbols(self, piece: str, ends: bool = True) -> list[str]:
        """Byte symbols of a pre-token or of a part of one; where the pre-token ends, the last has the end-of-word mark."""
        s = list(map(BYTE_SYMBOL.__getitem__, piece.encode("utf-8", "surrogatepass")))
        if s and ends:
            s[-1] += self.suffix
        return s

    def merge(self, s: list[str]) -> list[str]:
        """Tokens of a window of symbols: the merge of lowest rank first, leftmost among equals."""
        rank, s = self.rank.get, list(s)
        far = 1 << 60
        order = [rank(p, far) for p in pairwise(s)]
        while order:
            best = min(order)
            if best == far:
                break
            i = order.index(best)
            s[i] += s.pop(i + 1)
            del order[i]
            if i:
                order[i - 1] = rank((s[i - 1], s[i]), far)
            if i < len(order):
                order[i] = rank((s[i], s[i + 1]), far)
        return s


class StreamingEncoder:
    """Turns the symbols of one pre-token into tokens with a window of bounded length."""

    def __init__(self, table: MergeTable):
        self.table, self.held = table, []
        self.window = 2 * table.lookahead + 64

    def take(self, symbols: list[str], ends: bool = False) -> list[str]:
        """Takes more symbols and gives the tokens that are stable by now: all that is held, when the pre-token ends."""
        if ends and not self.held and len(symbols) <= self.window:
            return self.table.merge(symbols)
        out = []
        for i in range(0, len(symbols), self.window):
            self.held += symbols[i : i + self.window]
            while len(self.held) > self.window:
                edge, at = len(self.held) - self.table.lookahead, 0
                for token in self.table.merge(self.held):
                    if at + self.table.width(token) > edge:
                        break
                    at += self.table.width(token)
                    out.append(token)
                if not at:
                    break
                del self.held[:at]
        if ends:
            out += self.table.merge(self.held)
            self.held = []
        return out


def _normal(text: str) -> str:
    """The vocabulary's normal form; no part of it reaches over white space."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _words(text: str, at: int, end: int):
    """The normalised words of a part of a text, as lists of about CHUNK characters."""
    while at < end:
        cut = _SPACE.search(text, at + CHUNK, end) if end - at > CHUNK else None
        span = _normal(text[at : cut.start() if cut else end])
        yield _SPACE.split(span) if any([c in span for c in _SEPARATORS]) else span.split()
        at = cut.end() if cut else end


class Encoder:
    """Encodes whole texts; short words are remembered, long ones stream.

    A pre-token that stands alone is a word of one pre-token, so one cache serves both. It has two generations: when
    the younger is full it takes the older's place, and what was not asked for again is forgotten. Common words stay.
    """

    def __init__(self, path: str):
        self.table, self.young, self.old = MergeTable(path), {}, {}
        self.stream = StreamingEncoder(self.table)
        self.decimal = {i: str(i) for i in [*self.table.ids.values(), *self.table.special.values()]}

    def _known(self, word: str) -> tuple[int, ...]:
        """Ids of a short normalised word or pre-token, which is remembered."""
        got = self.young.get(word)
        if got is not None:
            return got
        got = self.old.get(word)
        if got is None:
            pieces = (word,) if word.isalpha() else PIECES.findall(word)
            if len(pieces) == 1 and pieces[0] == word:
                got = tuple([self.table.ids[t] for t in self.stream.take(self.table.symbols(word), True)])
            else:
                got = tuple(chain.from_iterable(map(self._known, pieces)))
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = got
        return got

    def _piece(self, piece: str):
        """Ids of a pre-token, block by block where it is long."""
        if len(piece) <= CACHE_CHARS:
            yield self._known(piece)
        else:
            for i in range(0, len(piece), CHUNK):
                ends = i + CHUNK >= len(piece)
                yield [self.table.ids[t] for t in self.stream.take(self.table.symbols(piece[i : i + CHUNK], ends), ends)]

    def _long(self, word: str):
        """Ids of a normalised word, as lists of its pre-tokens' ids that hold BLOCK_WORDS ids, or more by one block, in all."""
        held, n = [], 0
        for m in PIECES.finditer(word):
            for ids in self._piece(m[0]):
                held.append(ids)
                n += len(ids)
                if n >= BLOCK_WORDS:
                    yield held
                    held, n = [], 0
        yield held

    def _parts(self, text: str):
        """Ids, word by word in order (long words: in blocks), as lists of these; a special token's string counts as that token."""
        special = self.table.split_special
        at = 0
        for hit in chain(special.finditer(text) if special else (), (None,)):
            for words in _words(text, at, hit.start() if hit else len(text)):
                for start in range(0, len(words), BLOCK_WORDS):
                    block = words[start : start + BLOCK_WORDS]
                    found, done = list(map(self.young.get, block)), 0
                    for k, got in enumerate(found):
                        if got is None:
                            if len(block[k]) <= CACHE_CHARS:
                                found[k] = self._known(block[k])
                            else:
                                yield found[done:k]
                                yield from self._long(block[k])
                                done = k + 1
                    yield found[done:]
            if hit:
                yield [(self.table.special[hit[0]],)]
                at = hit.end()

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; null is empty."""
        return [i for part in self._parts(text or "") for i in chain.from_iterable(part)]

    def digest(self, text: str | None, kept: array | None = None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids joined by a space, and of what `Decoder` gives for these ids one by one; the ids are added to `kept`."""
        decoder, decimal = Decoder(self.table), self.decimal.__getitem__
        n, coded, said = 0, hashlib.sha256(), hashlib.sha256()
        for part in self._parts(text or ""):
            if ids := list(chain.from_iterable(part)):
                joined = " ".join(map(decimal, ids))
                coded.update((" " + joined if n else joined).encode())
                said.update(decoder.surfaces(ids).encode())
                n += len(ids)
                if kept is not None:
                    kept.extend(ids)
        return n, coded.hexdigest(), said.hexdigest()

    def forget(self) -> None:
        """Empties the caches."""
        self.young.clear()
        self.old.clear()


class Decoder:
    """Decodes token ids one at a time.

    `surface` gives each token's own string with a space between tokens, as a vocabulary without a decoder does.
    `text` is a byte-to-text state machine: it holds at most three bytes of an unfinished character, and turns
    end-of-word marks into a space.
    """

    def __init__(self, table: MergeTable):
        import codecs

        self.table, self.first = table, True
        self.said = table.surface.get
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def surface(self, token_id: int) -> str:
        said = self.said(token_id)
        if said is None:
            return ""
        if self.first:
            self.first = False
            return said
        return " " + said

    def surfaces(self, ids: list[int]) -> str:
        """What `surface` gives for these ids, one after another."""
        said = list(map(self.said, ids))
        if None in said:
            said = [t for t in said if t is not None]
        if not said:
            return ""
        joined = " ".join(said)
        if self.first:
            self.first = False
            return joined
        return " " + joined

    def text(self, token_id: int) -> str:
        said = self.table.surface.get(token_id, "")
        if said in self.table.special:
            return self.bytes.decode(b"", final=True) + said
        ends = bool(self.table.suffix) and said.endswith(self.table.suffix)
        said = said[: -len(self.table.suffix)] if ends else said
        return self.bytes.decode(bytes(SYMBOL_BYTE[c] for c in said)) + (" " if ends else "")

    def finish(self) -> str:
        return self.bytes.decode(b"", final=True)


def surface_text(table: MergeTable, ids) -> str:
    """Tokens' strings joined by a space, from ids."""
    decoder = Decoder(table)
    return "".join(map(decoder.surface, ids))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_frame(df: DataFrame, path: str, column: str = "text", out: str = "tokens") -> DataFrame:
    """`df` with the token ids of `column` as an array column `out` (which replaces a column of that name)."""
    kept = [f for f in df.schema.fields if f.name != out]
    place = df.columns.index(column)
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def encode(batches):
        e = encoder(path)
        for b in portions(batches, place):
            ids = pa.array([e.encode(t) for t in b.column(column).to_pylist()], pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), ids], [f.name for f in schema.fields])
        e.forget()
        give_back()

    return df.mapInArrow(encode, schema)


def digest_frame(df: DataFrame, path: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `df`: `key`, n_tokens, ids_sha256 and decoded_sha256 of the whole text; only two columns are read."""

    def digest(batches):
        e = encoder(path)
        for b in portions(batches, 1):
            made = [e.digest(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        e.forget()
        give_back()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(digest, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens_frame(df: DataFrame, path: str) -> DataFrame:
    """Per row of `df`: doc_id, source, the token ids of the whole text, their number and the digests of ids and decoded text."""

    def encode(batches):
        e = encoder(path)
        for b in portions(batches, 2):
            kept = array("i")
            made = [e.digest(t, kept) for t in b.column(2).to_pylist()]
            flat = pa.array(np.frombuffer(kept, np.int32) if kept else [], pa.int32())
            ends = np.concatenate([[0], np.cumsum([m[0] for m in made])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())],
                ["doc_id", "source", "tokens", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        e.forget()
        give_back()

    return df.select("doc_id", "source", "text").mapInArrow(encode, "doc_id long, source string, tokens array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the public word vocabulary; one scan, no shuffle."""
    return digest_frame(table(spark, sf_dir, "documents"), vocabulary())
