"""Questions with AND, OR, NOT, groups, fields and endings left open: which documents satisfy them, decided in one aggregation.

A question becomes its conditions, numbered, and a program in postfix order. The conditions meet postings, vocabulary and documents by equality joins; what a document meets is
collected, and the program is run on it by built-in functions.

Words side by side are joined by OR, which binds less than AND, and that less than NOT; a negation side by side with others takes away from all of them. `-` is NOT. `field:word` asks one field: title or text by the index, other columns of the documents
(FIELDS) by their whole value, in any case. `word*` stands for all words that begin so; "several words" must stand in a row. Signs that don't fit are passed over: a
closing bracket without an opening one, an operator without a side. Negations take away from what other conditions find: a question of nothing else finds nothing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..sources.shared import held, stated
from .index import FIELDS as TEXT_FIELDS
from .index import Index, asked_buckets, unpacked
from .rank import top
from .retrieve import best_first, keyword_scores, phrase_documents

#: Columns of documents that `column:value` may ask.
FIELDS = ("source", "subreddit", "sentiment", "subjectivity", "author", "content_type")
TOKEN = re.compile(r'\(|\)|-(?=\S)|(?:(\w+):)?"([^"]*)"|(?:(\w+):)?([^\s()":]+)')
STEP = "op string, leaf int, field string, kind string, value string, positive boolean"


def parsed(q: str | None) -> list[dict]:
    """The program of a question: steps `leaf` (with its condition), `not`, `and`, `or`."""
    tokens = [(m[0], m[1] or m[3], m[2], m[4]) for m in TOKEN.finditer(q or "")]
    at, leaves = 0, 0

    def here(*words: str) -> bool:
        return at < len(tokens) and tokens[at][0] in words

    def step(op: str, **more) -> dict:
        return {"op": op, "leaf": None, "field": None, "kind": None, "value": None, "positive": None, **more}

    def joined(parts: list[list[dict]], op: str) -> list[dict]:
        return [x for i, part in enumerate(parts) for x in (*part, *([step(op)] if i else []))]

    def one(positive: bool) -> list[dict]:
        """The steps of a condition, a group or a negation; none if there is none."""
        nonlocal at, leaves
        while here("AND", "OR"):
            at += 1
        if at >= len(tokens) or here(")"):
            return []
        text, field, phrase, word = tokens[at]
        at += 1
        if text in ("NOT", "-"):
            return [*found, step("not")] if (found := one(not positive)) else []
        if text == "(":
            found = some(positive)
            at += here(")")
            return found
        words = re.findall("[a-z0-9]+", (phrase if phrase is not None else word).lower())
        if not words:
            return []
        own = field is not None and field.lower() in FIELDS
        kind = "value" if own else "phrase" if phrase is not None or len(words) > 1 else "prefix" if word.endswith("*") else "term"
        value = (phrase if phrase is not None else word).lower() if own else " ".join(words)
        leaves += 1
        return [step("leaf", leaf=leaves, field=field.lower() if field and field.lower() in (*FIELDS, *TEXT_FIELDS) else None, kind=kind, value=value, positive=positive)]

    def every(positive: bool) -> list[dict]:
        nonlocal at
        parts = [one(positive)]
        while here("AND"):
            at += 1
            parts.append(one(positive))
        return joined([p for p in parts if p], "and")

    def some(positive: bool) -> list[dict]:
        nonlocal at
        any_, none, least = [], [], -1
        while at < len(tokens) and not here(")") and at > least:
            least, either = at, here("OR")
            at += either
            bare = here("NOT", "-") and not either
            if found := every(positive):
                (none if bare and found[-1]["op"] == "not" else any_).append(found)
        # A negation beside other conditions takes away from all of them.
        return joined([p for p in (joined(any_, "or"), *none) if p], "and")

    out = []
    while at < len(tokens):
        found = some(True)
        out = [p for p in (*out, found) if p]
        at += here(")")
    return joined(out, "or")


def programs(queries: DataFrame) -> DataFrame:
    """query_id, program of queries (query_id, q)."""

    @F.pandas_udf(f"array<struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in STEP.split(', '))}>>")
    def program(q: pd.Series) -> pd.Series:
        return q.map(parsed)

    return queries.select("query_id", program(F.coalesce("q", F.lit(""))).alias("program"))


def satisfied(program: Column, met: Column) -> Column:
    """Whether a program holds for a document that meets these conditions."""

    def run(stack: Column, s: Column) -> Column:
        n = F.size(stack)
        last, before = F.element_at(stack, -1), F.element_at(stack, -2)
        less = lambda k: F.slice(stack, F.lit(1), n - k)
        told = F.when(s["op"] == "leaf", F.concat(stack, F.array(F.array_contains(met, s["leaf"])))).when(s["op"] == "not", F.concat(less(1), F.array(~last)))
        return told.when(s["op"] == "and", F.concat(less(2), F.array(last & before))).otherwise(F.concat(less(2), F.array(last | before)))

    return F.aggregate(program, F.array().cast("array<boolean>"), run, lambda stack: F.coalesce(F.get(stack, F.lit(0)), F.lit(False)))


def matches(index: Index, leaves: DataFrame) -> DataFrame:
    """query_id, doc_id, leaf: the conditions (query_id, leaf, field, kind, value; literal rows) that documents meet."""
    of = lambda kind: leaves.where(F.col("kind") == kind)
    # A few lengths of beginnings: each word of the vocabulary is cut to these, and joined by equality.
    begins = of("prefix").select(F.length("value").alias("size"), F.col("value").alias("begin"), "query_id", "leaf", "field")
    sizes = sorted({r["size"] for r in begins.select("size").distinct().collect()})
    vocabulary = index.vocabulary.select("term").distinct()
    cut = vocabulary.select("term", F.explode(F.array(*(F.lit(s) for s in sizes)).cast("array<int>")).alias("size")).withColumn("begin", F.substring("term", 1, F.col("size")))
    words = of("term").select("query_id", "leaf", "field", F.col("value").alias("term"))
    if sizes:
        words = held(words.unionByName(cut.join(F.broadcast(begins), ["size", "begin"]).select("query_id", "leaf", "field", "term")), "words")
    saved = index.postings if index.blocks is None else asked_buckets(words, index.blocks).drop("positions")
    asked = words.withColumnRenamed("field", "only")
    rows = saved.select(*(c for c in ("segment", "term", "field", "doc_id", "doc_ids", "tfs", "dls") if c in saved.columns)).join(asked, "term").where("only IS NULL OR only = field")
    rows = rows if index.blocks is None else index.live(unpacked(rows))
    found = rows.select("query_id", "doc_id", "leaf")
    # A phrase counts as a question of its own.
    numbered = of("phrase").select(F.struct("query_id", "leaf").alias("query_id"), "field", F.posexplode(F.split("value", " ")).alias("j", "term"), F.size(F.split("value", " ")).alias("words"))
    if not numbered.isEmpty():
        stands = phrase_documents(index, numbered.withColumn("phrase", F.lit(0)).withColumnRenamed("field", "only"))
        found = found.unionByName(stands.select("query_id.query_id", "doc_id", "query_id.leaf"))
    values = of("value")
    if not values.isEmpty():
        own = [c for c in FIELDS if c in index.documents.columns]
        told = index.documents.select("doc_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.lower(F.col(c).cast("string")).alias("value")) for c in own))).alias("x")) if own else None
        if told is not None:
            found = found.unionByName(told.select("doc_id", "x.*").join(F.broadcast(values), ["field", "value"]).select("query_id", "doc_id", "leaf"))
    return found


def boolean_search(index: Index, queries: DataFrame, k: int | None = 100, config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, ord, doc_id, score of the best k documents that satisfy each of queries (query_id, q); all of them, in no order, without k.

    Scores are those of the question's words that aren't negated (see keyword_scores()); documents found by other conditions alone have 0. The index must have plain words.
    """
    told = stated(programs(queries))[0]
    leaves = stated(told.select("query_id", F.explode("program").alias("s")).where("s.op = 'leaf'").select("query_id", "s.leaf", "s.field", "s.kind", "s.value", "s.positive"))[0]
    met = matches(index, leaves.drop("positive")).groupBy("query_id", "doc_id").agg(F.collect_set("leaf").alias("met"))
    fine = met.join(F.broadcast(told), "query_id").where(satisfied(F.col("program"), F.col("met"))).select("query_id", "doc_id")
    terms = leaves.where("positive AND kind IN ('term', 'phrase')").select("query_id", F.explode(F.split("value", " ")).alias("term")).distinct()
    rows = fine.join(keyword_scores(index, terms, config), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows if k is None else top(rows, k, best_first())
