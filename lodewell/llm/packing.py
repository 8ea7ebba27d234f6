"""Vector bin packing of tokenised examples into sequences.

Each piece has three demands: tokens, segments (one) and loss-bearing tokens. A sequence is filled by
taking, again and again, the piece whose demands have the largest dot product with what is left of the
sequence's limits, among those that fit under all three. Where nothing fits and the gap is worth a cut,
the piece with the most tokens is cut to fill it; cutting is free, so padding stays under `min_cut`
tokens a sequence. Documents longer than a sequence first give whole sequences of their own.

Packing runs inside each partition over a pool of `pool` pieces that is refilled as documents stream by:
no shuffle, bounded memory, and a task that is run again gives the same sequences. At most one sequence
a partition is left part filled. Null text is empty: its only token is the end token. Repeated rows are
packed each on its own; an empty table gives no pieces.

Token ids are those of the `tokenizers` file: no special tokens are put in, and those written out in a text
(<|endoftext|>) have the ids of the file's added tokens. What is between them is encoded from its vocabulary and
merge order by the tiktoken library, which is several times faster at the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.llm.bpe import added_of_json, encode_added, encoding, ranks_of_json
from lodewell.plans.storage import small_batches


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    min_cut: int = 16
    pool: int = 4096
    end_id: int = 1


class Packer:
    """Pieces in, finished sequences out; a piece is (row, start, ids, loss flags or None)."""

    def __init__(self, limits: Limits):
        self.limits, self.items = limits, []

    def add(self, row: int, ids: np.ndarray, loss: np.ndarray | None) -> Iterator[list[tuple]]:
        """Whole sequences that the document fills alone; the rest goes to the pool."""
        lim, at = self.limits, 0
        while len(ids) - at >= lim.tokens and (loss is None and lim.loss_tokens >= lim.tokens):
            yield [(row, at, ids[at : at + lim.tokens], None)]
            at += lim.tokens
        while at < len(ids):
            end = self._fit(ids, loss, at, lim.tokens, lim.loss_tokens)
            self.items.append((row, at, ids[at:end], None if loss is None else loss[at:end]))
            at = end

    @staticmethod
    def _fit(ids: np.ndarray, loss: np.ndarray | None, at: int, tokens: int, loss_tokens: int) -> int:
        """The end of the longest piece from at under both limits."""
        end = min(len(ids), at + tokens)
        if loss is None:
            return min(end, at + loss_tokens)
        over = np.flatnonzero(np.cumsum(loss[at:end]) > loss_tokens)
        return at + int(over[0]) if len(over) else end

    def full(self) -> bool:
        return len(self.items) >= self.limits.pool

    def flush(self, last: bool) -> Iterator[list[tuple]]:
        """Pack the pool; unless last, pieces of the sequences that came out short go back to it."""
        lim, items = self.limits, self.items
        tok = np.array([len(x[2]) for x in items], np.float64)
        los = np.array([len(x[2]) if x[3] is None else int(x[3].sum()) for x in items], np.float64)
        alive = np.ones(len(items), bool)
        left = len(items)
        self.items = []
        while left:
            if not last and left < lim.pool // 4:
                self.items = [items[i] for i in np.flatnonzero(alive)]
                return
            r_tok, r_seg, r_los, bin_ = lim.tokens, lim.segments, lim.loss_tokens, []
            while left and r_tok and r_seg:
                fits = alive & (tok <= r_tok) & (los <= r_los)
                dot = np.where(fits, tok * (r_tok / lim.tokens**2) + los * (r_los / lim.loss_tokens**2) + r_seg / lim.segments**2, -1.0)
                i = int(np.argmax(dot))
                if not fits[i]:
                    if r_tok < lim.min_cut or r_los < lim.min_cut:
                        break
                    i = int(np.argmax(np.where(alive, tok, -1.0)))
                    row, start, ids, loss = items[i]
                    cut = self._fit(ids, loss, 0, int(r_tok), int(r_los))
                    if not 0 < cut < len(ids):
                        break
                    bin_.append((row, start, ids[:cut], None if loss is None else loss[:cut]))
                    items[i] = (row, start + cut, ids[cut:], None if loss is None else loss[cut:])
                    used = cut if loss is None else int(loss[:cut].sum())
                    tok[i] -= cut
                    los[i] -= used
                    r_tok, r_seg, r_los = r_tok - cut, r_seg - 1, r_los - used
                    continue
                bin_.append(items[i])
                alive[i] = False
                left -= 1
                r_tok, r_seg, r_los = r_tok - int(tok[i]), r_seg - 1, r_los - int(los[i])
            yield bin_


def pack_documents(docs: DataFrame, tokenizer_file: str, pattern: str, limits: Limits = Limits(), emit_ids: bool = True, prompt: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids).

    With `prompt`, a column of prompt texts, the prompt's tokens come first and bear no loss.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * emit_ids
    names = [c.split()[0] for c in schema.split(", ")]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(prompt) if prompt else F.lit(None)).cast("string").alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, added = encoding(ranks_of_json(tokenizer_file), pattern), added_of_json(tokenizer_file)
        packer, number = Packer(limits), TaskContext.get().partitionId() << 40
        about: dict[int, tuple] = {}  # row -> (doc_id, tokens, tokens not yet out)
        rows, seen = [], 0

        def put(sequence: list[tuple]) -> None:
            nonlocal number
            at = 0
            for row, start, ids, _ in sequence:
                doc_id, total, open_ = about[row]
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, number, at) + ((ids.astype(np.int32),) if emit_ids else ()))
                at += len(ids)
                if open_ == len(ids):
                    del about[row]
                else:
                    about[row] = (doc_id, total, open_ - len(ids))
            number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            done = [pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(done, names=names)

        for batch in batches:
            for doc_id, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = encode_added(enc, added, first)
                ids = np.array([*head, *encode_added(enc, added, text), limits.end_id], "<u4")
                loss = None
                if head:
                    loss = np.ones(len(ids), bool)
                    loss[: len(head)] = False
                about[seen] = (doc_id, len(ids), len(ids))
                for sequence in packer.add(seen, ids, loss):
                    put(sequence)
                seen += 1
                if packer.full():
                    for sequence in packer.flush(False):
                        put(sequence)
            yield out()
        for sequence in packer.flush(True):
            put(sequence)
        yield out()

    return own.mapInArrow(run, schema)
