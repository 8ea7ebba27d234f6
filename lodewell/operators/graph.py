"""Property graphs of code: nodes, edges, calls, and the proximity join of protocol marks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions import text as X
from lodewell.functions.tokens import fold, gaps
from lodewell.lexicon import BUILTINS
from lodewell.plans.storage import dealt, in_blocks


def node_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, edges): the edges of every node as structs (type, target, direction), sorted.

    The condition from = id or to = id is a union of two equi-joins; a self-loop gives its `out` row only.
    """
    out = edges.select(F.col("from_node").alias("id"), F.struct(F.coalesce("edge_type", F.lit("related")).alias("type"), F.col("to_node").alias("target"), F.lit("out").alias("direction")).alias("e"))
    in_ = edges.where("from_node != to_node").select(F.col("to_node").alias("id"), F.struct(F.coalesce("edge_type", F.lit("related")).alias("type"), F.col("from_node").alias("target"), F.lit("in").alias("direction")).alias("e"))
    lists = out.union(in_).groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    return nodes.select("id").join(lists, "id", "left").select("id", F.coalesce("edges", F.array().cast("array<struct<type:string,target:string,direction:string>>")).alias("edges"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in) of every node that has an edge, without its list; a self-loop counts as out only."""
    out = edges.select(F.col("from_node").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    in_ = edges.where("from_node != to_node").select(F.col("to_node").alias("id"), F.lit(0), F.lit(1))
    return out.union(in_).groupBy("id").agg(F.sum("out").alias("n_out"), F.sum("into").alias("n_in"))


def _met(edges: DataFrame, of: DataFrame, end: str, other: str, name: str) -> DataFrame:
    """(id, name): the distinct other ends of the edges of every given node.

    Edges are most often distinct already, so a task holds about all of its rows: their number is what is bounded.
    """
    met = edges.select(F.col(end).alias("id"), F.col(other).alias(name)).join(of.select("id"), "id", "left_semi")
    return dealt(met, edges.count(), "id", name).distinct()


def callers(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id, caller): the distinct callers of every given node."""
    return _met(edges, of, "to_node", "from_node", "caller")


def callees(edges: DataFrame, of: DataFrame) -> DataFrame:
    return _met(edges, of, "from_node", "to_node", "callee")


def call_chain(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id, callers, callees): sorted lists for a summary of a function."""
    a = callers(edges, of).groupBy("id").agg(F.sort_array(F.collect_set("caller")).alias("callers"))
    b = callees(edges, of).groupBy("id").agg(F.sort_array(F.collect_set("callee")).alias("callees"))
    empty = F.array().cast("array<string>")
    return of.select("id").join(a, "id", "left").join(b, "id", "left").select("id", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


def mentions(items: DataFrame, names: DataFrame, most: int = 5000) -> DataFrame:
    """(name, item_id): items whose text holds the name; names are broadcast, `most` at a time."""

    def block(some: DataFrame) -> DataFrame:
        return items.join(F.broadcast(some), F.lower("text").contains(F.lower("name"))).select("name", "item_id").distinct()

    return in_blocks(names.select("name").distinct(), "name", most, block)


def resolve_calls(calls: DataFrame, functions: DataFrame, builtins: tuple[str, ...] = BUILTINS) -> DataFrame:
    """calls (file, caller, callee) with target: func: if the file defines the callee or it is built in, else ext:."""
    own = functions.select("file", F.col("name").alias("callee"), F.lit(True).alias("known")).distinct()
    met = calls.join(own, ["file", "callee"], "left")
    known = F.coalesce("known", F.lit(False)) | F.col("callee").isin(*builtins)
    return met.select("file", "caller", "callee", F.concat(F.when(known, "func:").otherwise("ext:"), F.col("callee")).alias("target"))


def places(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, pos, match): all matches with their offsets."""
    t = F.col(text)
    none = F.array().cast("array<struct<pos:int,match:string>>")
    step = lambda at, x: (at + x["g"] + F.length(x["m"]), F.array(F.struct((at + x["g"]).alias("pos"), x["m"].alias("match"))))
    out = fold(gaps(t, pattern), step, "struct<pos:int,match:string>")
    return df.select(F.col(key), F.explode(F.when(t.rlike(pattern), out).otherwise(none)).alias("x")).select(key, "x.pos", "x.match")


def near(a: DataFrame, b: DataFrame, key: str, within: int = 200) -> DataFrame:
    """(key, pos, match, others): marks of b less than `within` characters from each mark of a, by place.

    A band join made equi: b falls into buckets of `within` characters and a looks into three of them.
    """
    bucket = lambda c: F.floor(F.col(c) / within)
    right = b.select(F.col(key), F.col("pos").alias("b_pos"), F.col("match").alias("b_match"), bucket("pos").alias("bucket"))
    left = a.withColumn("bucket", F.explode(F.sequence(bucket("pos") - 1, bucket("pos") + 1)))
    met = left.join(right, [key, "bucket"]).where(F.abs(F.col("pos") - F.col("b_pos")) < within)
    lists = met.groupBy(key, "pos", "match").agg(F.transform(F.sort_array(F.collect_list(F.struct("b_pos", "b_match"))), lambda x: x["b_match"]).alias("others"))
    return a.join(lists, [key, "pos", "match"], "left").select(key, "pos", "match", F.coalesce("others", F.array().cast("array<string>")).alias("others"))


#: What marks a data point and what marks a bus id.
DP_MARK = r"(?i)DP\s*[:.]?\s*\d+|DP\s*ID\s*[:.\s]*0x[0-9A-F]+|dp[_\s]*(?:id|data)"
CAN_MARK = r"(?i)0x[0-9A-F]{4,8}|CAN\s*(?:ID|报文|帧)|PGN\s*[:.\s]*0x[0-9A-F]+"


def dp_relations(df: DataFrame, key: str, text: str, within: int = 200) -> DataFrame:
    """(key, pos, dp_id, related_can_ids): data points with the bus ids near them; `unknown` where a mark has no number."""
    dp = F.coalesce(F.nullif(F.regexp_extract("match", r"0x([0-9A-Fa-f]+)", 1), F.lit("")), F.nullif(F.regexp_extract("match", r"(\d+)$", 1), F.lit("")), F.lit("unknown"))
    can = lambda m: F.coalesce(F.nullif(F.regexp_extract(m, "0x([0-9A-Fa-f]+)", 1), F.lit("")), F.lit("unknown"))
    return near(places(df, key, text, DP_MARK), places(df, key, text, CAN_MARK), key, within).select(key, "pos", dp.alias("dp_id"), F.transform("others", can).alias("related_can_ids"))


def function_search(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where((F.col("type") == "function") & F.lower("name").contains(name.lower()))


def graph_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes as knowledge items: id with the file before it (the plain id kept), type graph_<type>, edges, keywords."""
    lists = node_edges(nodes, edges)
    return nodes.join(lists, "id").select(F.concat_ws(":", F.col("file"), F.col("id")).alias("id"), F.col("id").alias("legacy_id"), F.concat(F.lit("graph_"), F.col("type")).alias("type"), F.lit("graph").alias("category"), F.col("name").alias("title"), F.col("file").alias("source_file"), "edges", X.node_keywords(F.col("type"), F.col("name"), F.coalesce("has_params", F.lit(False))).alias("keywords"))


def edges_text(edges: Column, most: int = 5) -> Column:
    return F.array_join(F.transform(F.slice(edges, 1, most), lambda e: F.concat_ws(":", e["type"], e["target"])), ", ")


_STRUCT = re.compile(r"(?:typedef\s+)?(struct|enum)\s*(\w*)\s*\{([^}]+)\}")
_MACRO = re.compile(r"^[ \t]*#define\s+(\w+)(?:\([^)]*\))?[ \t]+(.+)$", re.M)
_SWITCH = re.compile(r"switch\s*\(\s*(\w+)\s*\)\s*\{")
_HEAD = re.compile(r"^[ \t]*((?:[A-Za-z_]\w*[\s*]+)+)([A-Za-z_]\w*)\s*\(([^;{}()]*)\)\s*\{", re.M)
_GLOBAL = re.compile(r"^(?:static\s+|extern\s+|const\s+|volatile\s+)*[A-Za-z_]\w*[\s*]+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:=[^;]*)?;", re.M)
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_NOT_CALLS = frozenset({"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case"})


def _bare(code: str) -> str:
    """The code with comments and literals blanked out, offsets and lines unchanged."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', blank, code, flags=re.S)


def _close(code: str, at: int) -> int:
    """The place after the brace that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def code_parts(code: str) -> tuple[list[tuple], list[tuple]]:
    """Nodes (type, name, line, end_line, snippet, params) and edges (from, to, type) of a C file.

    A brace-matching scan: functions (pointer results too), their parameters and calls, structs, enums with
    their values, macros, state machines (switch), and globals, initialised ones included.
    """
    bare = _bare(code)
    line = lambda at: bare.count("\n", 0, at) + 1
    nodes, edges, inner = [], [], []
    functions = [m for m in _HEAD.finditer(bare) if m[2] not in _NOT_CALLS and m[1].split()[0] not in ("else", "return")]
    known = {m[2] for m in functions}
    for m in functions:
        end = _close(bare, m.end() - 1)
        inner.append((m.start(), end))
        params = [p.strip() for p in m[3].split(",") if p.strip() not in ("", "void")]
        nodes.append(("function", m[2], line(m.start(2)), line(end - 1), code[m.start() : end].strip(), params))
        for p in params:
            if names := re.findall(r"[A-Za-z_]\w*", p):
                edges.append((f"func:{m[2]}", f"param:{names[-1]}", "has_param"))
                if len(names) > 1:
                    edges.append((f"func:{m[2]}", f"type:{names[-2]}", "uses_type"))
        for name in dict.fromkeys(c for c in _CALL.findall(bare, m.end(), end) if c not in _NOT_CALLS):
            edges.append((f"func:{m[2]}", ("func:" if name in known else "ext:") + name, "calls"))
        for s in _SWITCH.finditer(bare, m.end(), end):
            nodes.append(("state_machine", f"state_machine_{s[1]}", line(s.start()), line(_close(bare, s.end() - 1) - 1), code[s.start() : _close(bare, s.end() - 1)], []))
    for m in _STRUCT.finditer(bare):
        inner.append(m.span())
        name = m[2] or f"anonymous_{m[1]}"
        nodes.append((m[1], name, line(m.start()), line(m.end() - 1), code[m.start() : m.end()], []))
        if m[1] == "enum":
            for value in re.findall(r"([A-Za-z_]\w*)\s*(?:=[^,}]*)?(?:,|$)", m[3].strip()):
                edges.append((f"enum:{name}", f"value:{value}", "has_value"))
    for m in _MACRO.finditer(bare):
        nodes.append(("macro", m[1], line(m.start()), line(m.start()), code[m.start() : m.end()].strip(), []))
    for m in _GLOBAL.finditer(bare):
        if not any(a <= m.start() < b for a, b in inner) and "typedef" not in m[0] and "return" not in m[0].split():
            nodes.append(("variable", m[1], line(m.start()), line(m.end() - 1), code[m.start() : m.end()].strip(), []))
    return sorted(nodes, key=lambda n: (n[2], n[0], n[1])), edges


def _scan(df: DataFrame, key: str, code: str, pick, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *x) for k, t in zip(pdf["file"], pdf["code"], strict=True) if isinstance(t, str) for x in pick(*code_parts(t))], columns=["file", *names])

    return df.select(F.col(key).cast("string").alias("file"), F.col(code).alias("code")).mapInPandas(run, f"file string, {schema}")


def code_nodes(df: DataFrame, key: str, code: str) -> DataFrame:
    """(file, type, name, line_start, line_end, code_snippet, params, id, subsystem, module) of C files."""
    rows = _scan(df, key, code, lambda nodes, edges: nodes, "type string, name string, line_start int, line_end int, code_snippet string, params array<string>")
    prefix = F.when(F.col("type") == "function", "func").otherwise(F.col("type"))
    return rows.withColumn("id", F.concat_ws(":", prefix, F.col("name"))).withColumn("subsystem", X.subsystem_of(F.col("file"))).withColumn("module", X.module_of(F.col("file"), F.col("code_snippet")))


def code_edges(df: DataFrame, key: str, code: str) -> DataFrame:
    """(file, from_node, to_node, edge_type) of C files."""
    return _scan(df, key, code, lambda nodes, edges: edges, "from_node string, to_node string, edge_type string")


def code_blocks(df: DataFrame, key: str, code: str) -> DataFrame:
    """Code nodes as blocks for indexing: id file:line:type:name, content under its context line, description."""
    n = code_nodes(df, key, code).where("type != 'variable'")
    name = F.element_at(F.split("file", "/"), -1)
    return n.select(F.concat_ws(":", F.col("file"), F.col("line_start").cast("string"), "type", "name").alias("id"), "type", "name", X.with_context(F.col("code_snippet"), name, F.col("module")).alias("content"), F.col("file").alias("file_path"), F.col("line_start").alias("line_number"), F.concat(F.lit("["), F.col("module"), F.lit("] "), name, F.lit(" "), F.col("type"), F.lit(": "), F.col("name")).alias("description"), "module")
