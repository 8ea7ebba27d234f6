"""Byte-level BPE by tiktoken from a local rank file.

Long texts are cut where no match of the pattern can cross: before white space that follows a
character other than white space. Every part is then encoded alone, so memory is bounded by the part,
and the ids are those of the whole text. Very long runs of white space, on which a matcher with look-ahead
runs out of stack, are taken out first: all of such a run but its last character before a word is one match of the
pattern (checked for the pattern given), and goes to the merges without the matcher. Decoding joins raw bytes, never characters, since a token may
end within one. Null text counts as empty: no ids. An unpaired surrogate cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.plans.storage import small_batches

#: Characters after which the next safe boundary is looked for.
PART = 1 << 18
#: White space as tiktoken's patterns have it (the Unicode property; \x1c to \x1f are not in it).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BOUNDARY = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: Runs of white space from this length on are not matched by the pattern.
RUN = 1 << 15
_RUNS = re.compile(f"[{_SPACE}]{{{RUN},}}")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ranks_of_json(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level tokenizer file whose ids follow its merge order (checked)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if order != sorted(order) or (order and order[0] < 256):
        raise ValueError(f"{path}: ids do not follow the merge order")
    low = set(range(256)) | set(order)
    return {token: i for token, i in ranks.items() if i in low}


def encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=8)
def _plain_runs(pattern: str) -> bool:
    """Whether the pattern takes a run of white space whole at the end of a text, and all but its last character before another."""
    import regex

    short = [" ", "\n", "\t", "\r", "\xa0", "\u3000"]
    runs = [c * 5 for c in short] + [a + b + a + b + a for a in short for b in short]
    return all(regex.findall(pattern, x + r) == [x, r] and regex.findall(pattern, x + r + y)[:2] == [x, r[:-1]] for r in runs for x in ("a", "1", "!") for y in ("a", "1", "!", "'s"))


def _match(enc, text: str) -> list[int]:
    """Ids of a text or part; very long runs of white space go past the matcher."""
    if len(text) < RUN or not _plain_runs(enc._pat_str):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in _RUNS.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about `size` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        cut = _BOUNDARY.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= PART:
        return _match(enc, text)
    out: list[int] = []
    for part in parts(text):
        out += _match(enc, part)
    return out


def added_of_json(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file and their ids; they are matched literally, anywhere in a text."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: an added token is not matched literally")
    return {t["content"]: t["id"] for t in added}


def encode_added(enc, added: dict[str, int], text: str | None) -> list[int]:
    """Ids where added tokens stand for themselves and what is between them is encoded alone."""
    if not text or not any(t in text for t in added):
        return encode(enc, text)
    out: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text):
        out += [added[part]] if part in added else encode(enc, part)
    return out


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id with ids (array<int>) and the decoded bytes; or, with digests, their count and hashes only.

    Every row gives one row, repeated rows too; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(load_ranks(rank_file), pattern)
        shown = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            one, two, three = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(enc, text)
                raw = enc.decode_bytes(ids)
                if digests:
                    one.append(len(ids))
                    two.append(hashlib.sha256(" ".join([shown[i] for i in ids]).encode()).hexdigest())
                    three.append(hashlib.sha256(raw).hexdigest())
                else:
                    one.append(ids)
                    two.append(raw)
            if digests:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.int64()), pa.array(two, pa.string()), pa.array(three, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.list_(pa.int32())), pa.array(two, pa.binary())], names=["doc_id", "ids", "decoded"])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {schema}")
