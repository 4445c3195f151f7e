"""Exact merge-type sentencepiece encoding by backtracking, and decoding.

An Aho-Corasick automaton over the reachable pieces gives all pieces that match at each position of a unit. The encoder
takes the longest one, checks that it is compatible with its left neighbour (merging both again gives back the pair),
else goes on with shorter ones; a position from which nothing fits is marked in a bitfield and not tried again. Every
prefix of a text has one encoding, hence a marked position is no token boundary at all. Units (see `pieces`) can't
influence each other, so an encoding is the concatenation of its units' encodings, which a bounded cache keeps.

Defined cases: a null text is empty; an empty text encodes as begin and end only and decodes to ''; characters without
a piece become byte tokens; a word mark U+2581 in a text decodes to a space, as with the library; repeated rows each
give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import CACHE_ENTRIES, CACHE_LENGTH, read, text_or_empty, tokenizer_path
from quern.llm.pieces import UNITS, marked, pieces


class Encoder(dict):
    """Unit -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import ahocorasick

        self.pieces, self.room, self.fits, self.fit_room = pieces(path), CACHE_ENTRIES, {}, CACHE_ENTRIES
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for t in self.pieces.alone():
            self.matches.add_word(t)
        self.matches.make_automaton()

    def compatible(self, pair: tuple[str, str]) -> bool:
        fits = self.pieces.merged(pair[0] + pair[1]) == [*pair]
        if self.fit_room:
            self.fit_room -= 1
            self.fits[pair] = fits
        return fits

    def tokens(self, unit: str) -> list[str]:
        size = len(unit)
        lengths = [2] * size  # bit n: a piece of n characters starts here; a lone character without a piece stands for its bytes
        for end, n in self.matches.iter(unit):
            lengths[end + 1 - n] |= 1 << n
        fits, tokens, left, at, failed = self.fits, [], None, 0, 0
        open_lengths, rest = [], lengths[0]
        while at < size:
            while rest:
                n = rest.bit_length() - 1
                rest ^= 1 << n
                if failed and failed >> at + n & 1:
                    continue
                token = unit[at : at + n]
                if left is None:
                    break
                ok = fits.get((left, token))
                if self.compatible((left, token)) if ok is None else ok:
                    break
            else:
                failed |= 1 << at
                at -= len(tokens.pop())
                rest = open_lengths.pop()
                left = tokens[-1] if tokens else None
                continue
            tokens.append(token)
            open_lengths.append(rest)
            left, at = token, at + n
            rest = lengths[at] if at < size else 0
        return tokens

    def __missing__(self, unit: str) -> bytes:
        ids = array("I")
        for token in self.tokens(unit):
            i = self.pieces.id.get(token)
            ids.extend([i] if i is not None else [self.pieces.byte_id[b] for b in token.encode()])
        out = ids.tobytes()
        if self.room and len(unit) <= CACHE_LENGTH:
            self.room -= 1
            self[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        units = UNITS.findall(marked(text))
        return b"".join(itemgetter(*units)(self)) if len(units) > 1 else b"".join(map(self.__getitem__, units))


class Surfaces(list):
    """At each id the bytes that it stands for."""

    def __init__(self, path: str):
        p = pieces(path)
        of = {i: t.encode() for i, t in p.text.items()} | {i: bytes([b]) for b, i in p.byte_id.items()} | dict.fromkeys(p.special, b"")
        super().__init__(of[i] for i in range(len(of)))
        self.byte_ids = frozenset(p.byte_id.values())

    def decode(self, ids: array) -> bytes:
        """UTF-8 of the text; one space in front is the model's own, unless a byte token made it."""
        out = b"".join(itemgetter(*ids)(self)) if len(ids) > 1 else b"".join(map(self.__getitem__, ids))
        if out[:1] == b" " and next(i for i in ids if self[i]) not in self.byte_ids:
            out = out[1:]
        return out.decode(errors="replace").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Encoder, Surfaces]:
    return Encoder(path), Surfaces(path)


def encode_decode(docs: DataFrame, path: str, with_output: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 for each row of docs; with_output adds ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, surfaces = codec(path)
        bos, eos = array("I", [encoder.pieces.bos]).tobytes(), array("I", [encoder.pieces.eos]).tobytes()
        for batch in batches:
            n, hashes, back, ids_out, decoded_out = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                raw = bos + encoder.encode(t) + eos
                ids = array("I", raw)
                decoded = surfaces.decode(ids)
                n.append(len(ids))
                hashes.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if with_output:
                    ids_out.append(ids.tolist())
                    decoded_out.append(decoded.decode())
            columns = {"key": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if with_output:
                columns |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(decoded_out, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_output
    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {"op9_piece_codec": op9_piece_codec}
ORACLE_SQL: dict[str, str] = {}
