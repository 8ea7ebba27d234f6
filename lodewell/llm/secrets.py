"""Secret scans with DataFrame functions only.

Three patterns give the base spans (assignments, access keys, hex runs). The method adds spans of kind
`entropy`: candidate strings are runs of 20 and more key characters; a candidate belongs to a character
class (hex, or mixed letters and digits), and a window slides over it with counts that are changed by one
character in and one out, so the sum of c * log2(c) and with it the Shannon entropy is kept up step by
step. A candidate is a span where its highest window entropy reaches the class's limit, unless the
allow-list names it: placeholders, counting runs, identifiers with dashes, words and plain numbers.
The allow-list never suppresses base spans.

Positions are code points, ends exclusive. All is done in the row, without a shuffle; matches are folded in
blocks, so time grows with the text. Null text is empty and has no spans; every row gives one row; extra columns are ignored.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions.tokens import fold, gaps, let

#: Fixed patterns of the base scan.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOW = (
    r"(?i)(example|sample|dummy|placeholder|changeme|redacted|xxxx|0123456789|1234567890|abcdefgh|00000000)",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
)
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character in the best window, by class.
HEX_BITS, MIXED_BITS = 3.0, 3.7
_SPAN = "struct<start:int,kind:int,end:int>"
_BLOCK = 256


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that pass `keep`, from the gaps between matches."""
    none = F.array().cast(f"array<{_SPAN}>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["g"]
        end = start + F.length(x["m"])
        own = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return end, F.when(keep(x["m"]), own).otherwise(none)

    return F.when(text.rlike(pattern), fold(gaps(text, pattern), step, _SPAN)).otherwise(none)


def window_entropy(s: Column) -> Column:
    """The highest Shannon entropy of WINDOW consecutive characters, by incremental counts; 0 for shorter strings.

    There is a count for each character of the string's own alphabet, some twenty for most candidates.
    """
    weight = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    f = lambda c: F.element_at(weight, c + 1)

    def of(chars: Column, letters: Column) -> Column:
        codes = F.transform(chars, lambda ch: F.array_position(letters, ch).cast("int"))
        back = let(codes, lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), c), 1, F.size(c)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
        moves = F.transform(back, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), i.alias("i")))

        def step(acc: Column, x: Column) -> Column:
            n, a, b = acc["n"], x["a"], x["b"]
            gone = F.when(b > 0, F.element_at(n, F.greatest(b, F.lit(1)))).otherwise(F.lit(0))
            here = F.element_at(n, a) - F.when(a == b, 1).otherwise(0)
            total = acc["s"] + F.when(b > 0, f(F.greatest(gone - 1, F.lit(0))) - f(gone)).otherwise(F.lit(0.0)) + f(here + 1) - f(here)
            counts = F.transform(n, lambda c, k: c + F.when(k + 1 == a, 1).otherwise(0) - F.when(k + 1 == b, 1).otherwise(0))
            bits = F.lit(log2(WINDOW)) - total / F.lit(float(WINDOW))
            best = F.when(x["i"] >= WINDOW - 1, F.greatest(acc["best"], bits)).otherwise(acc["best"])
            return F.struct(counts.alias("n"), total.alias("s"), best.alias("best"))

        start = F.struct(F.array_repeat(F.lit(0), F.size(letters)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(moves, start, step, lambda acc: acc["best"])

    return let(F.split(s, ""), lambda chars: let(F.array_distinct(chars), lambda letters: of(chars, letters)))


def _secret_like(s: Column) -> Column:
    allowed = s.rlike(ALLOW[0])
    for pattern in ALLOW[1:]:
        allowed = allowed | s.rlike(pattern)
    limit = F.when(s.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(MIXED_BITS)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(s) >= limit)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc, a struct of all columns; text, null as empty; found: array of (start, kind, end), sorted by start, then kind."""
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    every = lambda m: F.lit(True)
    found = F.concat(
        _spans(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
        _spans(t, ACCESS, 1, every),
        _spans(t, HEX, 2, every),
        _spans(t, CANDIDATE, 3, _secret_like),
    )
    return rows.select("doc", "text", F.sort_array(found).alias("found"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every document."""
    rows = scan(docs.select("doc_id", "text")).select(F.col("doc.doc_id").alias("doc_id"), "found", F.filter("found", lambda x: x["kind"] < 3).alias("base"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def _without(text: Column, found: Column, mark: str) -> Column:
    """The text with its spans, overlapping ones as one, put as mark. Each block of spans works on its own stretch of text."""

    def of_block(acc: Column, k: Column) -> Column:
        own = F.slice(found, k * _BLOCK + 1, _BLOCK)
        stop = F.greatest(acc["at"], F.array_max(F.transform(own, lambda x: x["end"])))

        def of(stretch: Column) -> Column:
            def step(inner: Column, x: Column) -> Column:
                piece = F.array(F.substr(stretch, inner["at"] - acc["at"] + 1, F.greatest(x["start"] - inner["at"], F.lit(0))), F.lit(mark))
                return F.struct(F.greatest(inner["at"], x["end"]).alias("at"), F.when(x["start"] >= inner["at"], F.concat(inner["out"], piece)).otherwise(inner["out"]).alias("out"))

            return F.aggregate(own, F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")), step, lambda r: F.struct(r["at"].alias("at"), F.array_join(r["out"], "").alias("out")))

        return let(F.substr(text, acc["at"] + 1, stop - acc["at"]), lambda stretch: let(of(stretch), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))))

    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(blocks, start, of_block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """The documents with each secret, overlapping ones as one, put as `mark`; texts without secrets are untouched."""
    rows = scan(docs)
    any_ = F.size("found") > 0
    new = rows.select("doc", any_.alias("any"), F.when(any_, _without(F.col("text"), F.col("found"), mark)).otherwise(F.col("doc.text")).alias("text"))
    of = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        of["n_chars"] = F.when(F.col("any"), F.length("text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return new.select(*[of.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
