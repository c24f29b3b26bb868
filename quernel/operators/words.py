"""Word clouds, title suggestions, spelling hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CLOUD_STOP_WORDS, plain_tokens, snippet
from .rank import top

# Words of the field that spelling hints should know.
DOMAIN_WORDS = (
    "copilot", "claude code", "codex", "kline", "llama", "gemma", "gpt", "haiku", "sonnet", "opus", "cursor", "windsurf", "codewhisperer", "tabnine", "codeium", "supermaven", "devin", "chatgpt", "gemini", "replit", "jetbrains",
    "claude", "kimi", "grok", "cline", "lovable", "antigravity", "bolt", "roo", "kilo", "openai", "mistral", "anthropic", "deepseek", "moonshot",
    "ai", "llm", "llms", "agentic", "finetune", "finetuning", "finetuned", "hallucinate", "hallucination", "hallucinations", "hallucinating", "hallucinated",
    "vscode", "ide", "neovim", "nvim", "pycharm", "intellij", "github", "gitlab", "stackoverflow", "reddit", "subreddit", "docker", "dockerfile", "kubectl", "localhost",
    "npm", "pip", "sdk", "cli", "cors", "json", "yaml", "toml", "huggingface", "openrouter", "eslint", "linter", "linting", "pytorch", "tensorflow",
    "autocomplete", "autocompletion", "autoformat", "refactor", "refactoring", "plugin", "snippet", "workflow", "bugfix", "codebase", "boilerplate", "typescript", "javascript", "golang", "async", "await", "regex", "config",
    "upvote", "upvotes", "downvote", "downvotes", "v0",
)
DOMAIN_FREQUENCY = 1_000_000
# Fixed value: a word that is no word, so that it is corrected to one of the field.
NO_WORD = "claud"


def word_cloud(rows: DataFrame, stop_words: tuple[str, ...] = CLOUD_STOP_WORDS, most: int = 60) -> DataFrame:
    """query_id, word, weight, tier, place of the heaviest words in titles and snippets. An occurrence weighs 1, or 1 + similarity where that is positive.

    Stop words, words under three letters and numbers don't count. Tier: 1 above 0.6 of the heaviest weight, 2 above 0.3, else 3.
    """
    weight = F.when(F.col("similarity") > 0, 1 + F.col("similarity")).otherwise(F.lit(1.0))
    tokens = plain_tokens(F.concat_ws(" ", "title", snippet(F.col("text"))))
    fine = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.isin(*stop_words))
    sums = rows.select("query_id", weight.alias("w"), F.explode(fine).alias("word")).groupBy("query_id", "word").agg(F.round(F.sum("w"), 6).alias("weight"))
    best = top(sums, most, [F.col("weight").desc(), F.col("word")], "place")
    share = F.col("weight") / F.max("weight").over(Window.partitionBy("query_id"))
    return best.withColumn("tier", F.when(share > 0.6, 1).when(share > 0.3, 2).otherwise(3)).withColumn("weight", F.floor(F.col("weight") + 0.5).cast("long"))


def suggestions(rows: DataFrame, most: int = 8, width: int = 80) -> DataFrame:
    """query_id, place, suggestion: distinct titles of the first `most` rows in their order, cut to the width. A row without a title stands for itself by the start of its text."""
    cut = lambda c: F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)
    head = rows.where(F.col("ord") <= most).withColumn("full", F.coalesce(F.nullif(F.trim("title"), F.lit("")), cut(F.trim("text"))))
    first = head.where(F.col("full") != "").groupBy("query_id", "full").agg(F.min("ord").alias("ord"))
    return top(first, most, [F.col("ord")], "place").select("query_id", "place", cut(F.col("full")).alias("suggestion"))


def swapped(a: Column, b: Column) -> Column:
    """Whether two words differ by one swap of neighbouring letters."""
    at = lambda i: F.concat(a.substr(F.lit(1), i), a.substr(i + 2, F.lit(1)), a.substr(i + 1, F.lit(1)), a.substr(i + 3, F.length(a))) == b
    return (F.length(a) == F.length(b)) & (a != b) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(0), F.greatest(F.length(a) - 2, F.lit(0))), at)


def domain_words(rows: DataFrame, domain: tuple[str, ...]) -> DataFrame:
    return rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domain))).alias("word"), F.lit(DOMAIN_FREQUENCY).cast("long").alias("n"))


def known_words(vocabulary: DataFrame, domain: tuple[str, ...] = DOMAIN_WORDS) -> DataFrame:
    """word, n: the corpus's words (term, n) and the field's, which count as very frequent."""
    own = domain_words(vocabulary, domain)
    return vocabulary.select(F.col("term").alias("word"), F.col("n").cast("long")).unionByName(own).where(F.col("word") != NO_WORD).groupBy("word").agg(F.max("n").alias("n"))


def with_domain(near: DataFrame, domain: tuple[str, ...] = DOMAIN_WORDS) -> DataFrame:
    """near (key, word, n; see keyed()) of the corpus's words, and the field's."""
    rows = near.unionByName(keyed(domain_words(near, domain))).where(F.col("word") != NO_WORD)
    return rows.groupBy("key", "word").agg(F.max("n").alias("n"))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """query_id, pos, token, word of tokens of queries (query_id, q) that are checked: short tokens, numbers and tokens with a colon aren't."""
    tokens = queries.select("query_id", F.posexplode(F.split(F.trim("q"), r"\s+")).alias("pos", "token"))
    return tokens.where((F.length("token") > 2) & ~F.contains("token", F.lit(":")) & ~F.col("token").rlike("^[0-9]+$")).withColumn("word", F.lower("token"))


def spelling(queries: DataFrame, words: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """query_id, pos, token, correction, distance for tokens of queries (query_id, q) that words (word, n) lacks: of the words at one edit (a swap
    is one), or else at two, the most frequent.

    Words cut into three parts keep one of them whole through two edits: tokens and words meet by these parts (see keyed()), an equality join, and no token is
    compared with all words. near: what keyed() makes of the words, as an index has it saved; words then only need to hold the tokens that are words.
    """
    odd = asked_tokens(queries).withColumnRenamed("word", "low").join(words.select(F.col("word").alias("low")), "low", "left_anti")
    asked = odd.select("query_id", "pos", "token", "low", F.explode(probes_of(F.col("low"))).alias("key"))
    pairs = (keyed(words) if near is None else near).select("key", "word", "n").join(F.broadcast(asked), "key").drop("key").distinct()
    distance = F.levenshtein("low", "word")
    told = pairs.withColumn("distance", F.when(swapped(F.col("low"), F.col("word")), 1).otherwise(distance)).where(F.col("distance") <= 2)
    best = F.row_number().over(Window.partitionBy("query_id", "pos").orderBy("distance", F.col("n").desc(), "word"))
    return told.withColumn("r", best).where("r = 1").select("query_id", "pos", "token", F.col("word").alias("correction"), "distance")


def corrected(queries: DataFrame, hints: DataFrame) -> DataFrame:
    """query_id, corrected: each query (query_id, q) that a hint (see spelling()) changes, with its corrections in place."""
    tokens = queries.select("query_id", F.posexplode(F.split(F.trim("q"), r"\s+")).alias("pos", "token"))
    put = tokens.join(hints.select("query_id", "pos", "correction"), ["query_id", "pos"], "left")
    changed = F.coalesce(F.lower("token") != F.lower("correction"), F.lit(False))
    word = F.struct("pos", F.when(changed, F.col("correction")).otherwise(F.col("token")).alias("word"))
    told = put.groupBy("query_id").agg(F.array_sort(F.collect_list(word)).alias("words"), F.bool_or(changed).alias("changed"))
    return told.where("changed").select("query_id", F.array_join("words.word", " ").alias("corrected"))


#: Parts of a word: one more than the edits that a correction may have.
PARTS, EDITS = 3, 2


def _part(length: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of part i of a word of this length; the last parts are the longer ones."""
    short, longer = F.call_function("div", length, F.lit(PARTS)).cast("int"), (length % PARTS).cast("int")
    extra = F.greatest(i - (PARTS - longer), F.lit(0))
    return i * short + extra, short + F.when(i >= PARTS - longer, 1).otherwise(0)


def _key(length: Column, i: Column, text: Column) -> Column:
    return F.concat_ws(":", length.cast("string"), i.cast("string"), text)


def parts_of(word: Column) -> Column:
    """Keys of a word's parts: its length, the part's number, its letters."""

    def key(i: Column) -> Column:
        start, size = _part(F.length(word), i)
        return _key(F.length(word), i, word.substr(start + 1, size))

    return F.transform(F.array(*map(F.lit, range(PARTS))), key)


def probes_of(token: Column) -> Column:
    """Keys of which each word that is at most EDITS edits away has one: a part that no edit touches stands in the token at most EDITS letters off its place."""
    m = F.length(token)

    def of_part(length: Column, i: Column) -> Column:
        start, size = _part(length, i)
        fits = F.filter(F.array(*(F.lit(d) for d in range(-EDITS, EDITS + 1))), lambda d: (start + d >= 0) & (start + d + size <= m))
        return F.transform(fits, lambda d: _key(length, i, token.substr(start + d + 1, size)))

    lengths = F.filter(F.transform(F.array(*(F.lit(d) for d in range(-EDITS, EDITS + 1))), lambda d: m + d), lambda x: x > 0)
    parts = F.transform(lengths, lambda x: F.flatten(F.transform(F.array(*map(F.lit, range(PARTS))), lambda i: of_part(x, i))))
    return F.array_distinct(F.flatten(parts))


def keyed(words: DataFrame) -> DataFrame:
    """words (word, ...) by their parts: a row with key for each."""
    return words.where(F.length("word") > 0).select(F.explode(parts_of(F.col("word"))).alias("key"), *words.columns)
