"""SentencePiece encoding with the byte span of every piece in the text as given, and decoding.

A text is first normalised here, by the model's own settings: at each place the longest key of the compiled character
map (a double-array trie) is replaced by its value, a character without a key stays; surplus blanks go where the model says so, a
blank is put in front, and blanks become U+2581. Every byte of the result records the byte of the text that it
comes from. The normalised text is encoded by the sentencepiece library with the normaliser of the model taken
out; the lengths of the pieces then run along the record, which gives each piece its span of original bytes.
Where no piece of the vocabulary has a U+2581 after another character, no merge crosses such a place, and long
texts are encoded in parts cut there.

Spans follow the library: the bytes of an unknown character have empty spans but for the last, which has it
all; the end id has an empty span at the end. Null text is empty; every row gives one row, repeated rows too; a table without rows
gives none; extra columns are ignored. Text that the normaliser empties gives the end id alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.plans.storage import small_batches

#: What stands for a blank in pieces.
MARK = "▁"
#: Characters after which the next safe cut is looked for.
PART = 1 << 18
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")


class CharacterMap:
    """The compiled character map of a model: longest keys by a walk through its double array."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.values = blob[4 + size :]
        self._live: dict[str, bool] = {}

    def _step(self, node: int, byte: int) -> int:
        """The node behind byte, or -1."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else -1

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def longest(self, data: bytes, at: int = 0) -> tuple[bytes, int] | None:
        """The replacement of the longest key that starts here and the key's bytes; None without a key."""
        best, node, k = None, self._child(0), at
        while k < len(data):
            here = self._step(node, data[k])
            if here < 0:
                break
            k += 1
            node = self._child(here)
            if self.units[here] & 0x100:
                best = (self.units[node] & 0x7FFFFFFF, k - at)
        if best is None:
            return None
        start = best[0]
        return self.values[start : self.values.index(b"\0", start)], best[1]

    def live(self, c: str) -> bool:
        """Whether a key starts with this character."""
        if not self.units:
            return False
        found = self._live.get(c)
        if found is None:
            node = self._child(0)
            for byte in c.encode():
                here = self._step(node, byte)
                if here < 0:
                    break
                node = self._child(here)
            found = self._live[c] = here >= 0
        return found


class Normalizer:
    """Text to normalised bytes and, for each of them and the end, the byte of the text it comes from."""

    def __init__(self, spec, suffix: bool = False, kept: tuple[str, ...] = ()):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.kept = sorted((k for k in kept if k), key=len, reverse=True)

    def _mapped(self, text: str, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The replaced bytes, their source bytes, and where a unit (a key or a character) begins."""
        raw = np.frombuffer(data, np.uint8)
        at = np.arange(len(raw))
        lead = (raw & 0xC0) != 0x80
        source = np.maximum.accumulate(np.where(lead, at, 0)) if len(raw) else at
        keys = self.kept + sorted(c for c in set(text) if self.map.live(c))
        if not keys:
            return data, source, lead
        find = re.compile("|".join(map(re.escape, keys)).encode())
        out, sources, heads, last = [], [], [], 0
        hit = find.search(data)
        while hit is not None:
            here = hit.start()
            if hit.group().decode() in self.kept:
                new, used = hit.group(), len(hit.group())
            elif (met := self.map.longest(data, here)) is None:
                hit = find.search(data, hit.end())
                continue
            else:
                new, used = met
            out += [data[last:here], new]
            sources += [source[last:here], np.full(len(new), here)]
            head = np.zeros(len(new), bool)
            head[:1] = True
            heads += [lead[last:here], head]
            last = here + used
            hit = find.search(data, last)
        out.append(data[last:])
        sources.append(source[last:])
        heads.append(lead[last:])
        return b"".join(out), np.concatenate(sources), np.concatenate(heads)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        made, source, head = self._mapped(text, data)
        b = np.frombuffer(made, np.uint8)
        end = len(data)
        if self.trim:
            blank = b == 32
            # a unit's leading blanks go where the byte before the unit is a blank, or there is none
            unit = np.cumsum(head) - 1
            starts = np.flatnonzero(head)
            after = np.ones(len(starts), bool)
            after[1:] = blank[starts[1:] - 1]
            since = np.cumsum(~blank)
            before = np.concatenate(([0], since[starts[1:] - 1])) if len(starts) else since
            drop = blank & after[unit] & (since == before[unit]) if len(b) else blank
            b, source = b[~drop], source[~drop]
            if not (b != 32).any():
                return b"", np.zeros(1, np.int64)
        first = int(source[0]) if self.trim else 0
        mark = MARK.encode() if self.escape else b" "
        if self.escape:
            source = np.repeat(source, np.where(b == 32, 3, 1))
        made = b.tobytes().replace(b" ", mark)
        if self.prefix and not self.suffix:
            made, source = mark + made, np.concatenate((np.full(len(mark), first), source))
        if self.trim:
            while made.endswith(mark):
                made, end = made[: -len(mark)], int(source[len(made) - len(mark)])
            source = source[: len(made)]
        if self.prefix and self.suffix:
            made, source = made + mark, np.concatenate((source, np.full(len(mark), end)))
        return made, np.append(source, end)


class Encoder:
    """Ids, spans and decoded text by one model file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model = pb.ModelProto()
        model.ParseFromString(proto)
        kinds = pb.ModelProto.SentencePiece
        kept = tuple(p.piece for p in model.pieces if p.type == kinds.USER_DEFINED)
        self.normalize = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix, kept)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.lengths = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.UNKNOWN else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.bytes = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.whole = any(p.type not in (kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) and _CUT.search(p.piece) for p in model.pieces)
        for k in ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"):
            setattr(model.normalizer_spec, k, False)
        model.normalizer_spec.name, model.normalizer_spec.precompiled_charsmap = "identity", b""
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end = self.decoder.eos_id()

    def parts(self, text: str, size: int = PART) -> Iterator[str]:
        at = 0
        while not self.whole and len(text) - at > size:
            cut = _CUT.search(text, at + size)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the end id, and the first and end byte of each in the text's UTF-8."""
        data, source = self.normalize(text or "")
        ids, edges, done = [], [np.zeros(1, np.int64)], 0
        for part in self.parts(data.decode()):
            if not part:
                continue
            own = np.asarray(self.engine.encode(part, return_type="numpy"), np.int64)
            size = len(part.encode())
            stops = np.cumsum(self.lengths[own])
            if not len(own) or stops[-1] != size:
                # pieces of unknown characters: the library tells how far each goes
                met = self.engine.encode(part, return_type="proto").pieces
                own = np.array([p.id for p in met], np.int64)
                stops = np.cumsum([len(p.surface.encode()) for p in met])
            ids.append(own)
            edges.append(stops + done)
            done += size
        ids = np.concatenate([*ids, np.array([self.end] if self.end >= 0 else [], np.int64)])
        edge = source[np.concatenate(edges)]
        starts, stops = edge[:-1], edge[1:]
        n = len(starts)
        single = self.bytes[ids[:n]]
        if single.any():
            # within an unknown character no piece but the last moves on
            inner = single & (np.append(starts[1:], -1) == starts)
            stops = np.where(inner, starts, stops)
        if self.end >= 0:
            starts, stops = np.append(starts, source[-1]), np.append(stops, source[-1])
        return ids, starts, stops

    def decode(self, ids: np.ndarray) -> str:
        return self.decoder.decode(ids.tolist())


def encode_documents(docs: DataFrame, model_file: str, digests: bool = False) -> DataFrame:
    """doc_id with ids, starts, stops (arrays, bytes of the text) and the decoded text; with digests, their counts and hashes only."""
    small_batches(docs.sparkSession)
    if digests:
        schema, types = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", [pa.int64()] * 2 + [pa.string()] * 3
    else:
        schema, types = "doc_id long, ids array<int>, starts array<long>, stops array<long>, decoded string", [pa.int64(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 2, pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, hashed = Encoder(model_file), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                ids, starts, stops = encoder.encode(text)
                back = encoder.decode(ids)
                if digests:
                    spans = np.stack((starts, stops)).astype("<i8").tobytes()
                    rows.append((doc_id, len(ids), hashed(" ".join(map(str, ids.tolist())).encode()), hashed(back.encode()), hashed(spans)))
                else:
                    rows.append((doc_id, ids.astype(np.int32), starts, stops, back))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
