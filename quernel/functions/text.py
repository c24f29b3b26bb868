"""Text analysis: tokens, stop words, stems, aspects, display names."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual short English stop-word list of search servers.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

# Words that word clouds leave out.
CLOUD_STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "after", "before", "between", "out", "off", "over", "under", "again", "then", "once", "per",
    "via", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her",
    "us", "them", "my", "your", "his", "its", "our", "their", "this", "that", "these", "those", "what", "which", "who", "when", "where", "why", "how", "all", "each", "not", "no", "so", "too", "very", "just", "also", "both", "few", "more", "most",
    "other", "some", "such", "only", "same", "than", "there", "here", "ever", "never", "always", "still", "even", "though", "yet", "really", "well", "get", "got", "go", "going", "make", "made", "take", "took", "give", "gave", "see", "saw", "know",
    "think", "use", "used", "using", "feel", "want", "try", "let", "put", "say", "said", "tell", "told", "find", "found", "work", "look", "like", "mean", "good", "bad", "great", "better", "best", "new", "old", "right", "true", "false", "sure",
    "different", "reddit", "post", "comment", "thread", "lol", "yeah", "yes", "thanks", "thank", "please", "help", "anyone", "people", "someone", "something", "nothing", "things", "thing", "stuff", "lot", "bit", "way", "time", "day", "year", "one",
    "two", "three", "dont", "doesnt", "cant", "wont", "isnt", "wasnt", "havent", "didnt", "wouldnt", "much", "many", "any", "every", "own", "since", "while", "now", "back", "down", "come", "came",
)

# Aspects and the substrings that tell them, in the order of output.
ASPECTS = {
    "productivity": ("productivity", "productive", "efficiency", "efficient", "workflow"),
    "trust_reliability": ("trust", "reliable", "reliability", "stable", "stability", "trustworthy", "consistent", "dependable"),
    "code_quality": ("code quality", "quality", "correctness", "accurate", "accuracy", "hallucination", "wrong code", "buggy code"),
    "control": ("control", "autonomy", "customize", "customization", "configure", "configuration", "override"),
    "security_privacy": ("security", "secure", "privacy", "private", "data privacy", "safe", "vulnerable", "vulnerability"),
    "learning_impact": ("learn", "learning", "education", "educational", "skill", "upskill", "reskill", "training"),
    "job_security": ("job", "employment", "replace", "replacement", "automation", "career", "laid off", "redundant"),
    "cost_value": ("cost", "price", "pricing", "expensive", "cheap", "value", "money", "affordable", "subscription", "pay", "billing"),
    "token_usage": ("token", "tokens", "context window", "context limit", "rate limit"),
    "integration_ux": ("integration", "integrate", "ux", "ui", "interface", "setup", "install", "plugin", "extension"),
    "troubleshooting": ("debug", "debugging", "fix", "troubleshoot", "error", "issue", "problem", "crash", "bug"),
}

# Names and labels as shown to users.
TOOL_NAMES = {
    "copilot": "Copilot", "cursor": "Cursor", "claude_code": "Claude Code", "devin": "Devin", "codewhisperer": "CodeWhisperer", "tabnine": "Tabnine", "windsurf": "Windsurf", "chatgpt": "ChatGPT", "gemini": "Gemini", "codeium": "Codeium", "supermaven": "Supermaven", "replit_ai": "Replit AI",
    "amazon_q": "Amazon Q", "jetbrains_ai": "JetBrains AI", "v0": "v0", "bolt": "Bolt", "antigravity": "Antigravity", "lovable": "Lovable", "kimi_code": "Kimi Code", "grok_code": "Grok Code", "cline": "Cline", "roo_code": "Roo Code", "kilo_code": "Kilo Code",
}
SENTIMENT_LABELS = {"positive": "Positive", "negative": "Negative", "mixed": "Mixed", "not_applicable": "Neutral"}
SENTIMENT_COLORS = {"positive": "#4caf50", "negative": "#f44336", "mixed": "#ff9800", "not_applicable": "#9e9e9e"}


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, with inner apostrophes, in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"), F.lit(0))


def english_terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """word_tokens without stop words, possessive endings dropped; still to be stemmed (stem_table)."""
    kept = F.filter(word_tokens(text), lambda t: ~t.isin(*stop_words))
    possessive = lambda t: F.endswith(t, F.lit("'s")) | F.endswith(t, F.lit("’s"))
    return F.transform(kept, lambda t: F.when(possessive(t), t.substr(F.lit(1), F.length(t) - 2)).otherwise(t))


class Porter:
    """The suffix-stripping algorithm of M. F. Porter (1980), for lower-case ASCII words."""

    STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
    STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    def vowels(self, w: str) -> str:
        """v and c for each letter: y is a vowel after a consonant."""
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
        return out

    def measure(self, w: str) -> int:
        return self.vowels(w).count("vc")

    def short_end(self, w: str) -> bool:
        return self.vowels(w).endswith("cvc") and w[-1] not in "wxy"

    def replaced(self, w: str, pairs, least: int) -> str:
        for end, new in sorted(pairs, key=lambda p: -len(p[0])):
            if w.endswith(end):
                base = w[: -len(end)]
                return base + new if self.measure(base) > least else w
        return w

    def stem(self, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end):
                    if "v" in self.vowels(w[: -len(end)]):
                        w = w[: -len(end)]
                        if w.endswith(("at", "bl", "iz")):
                            w += "e"
                        elif len(w) > 1 and w[-1] == w[-2] and self.vowels(w)[-1] == "c" and w[-1] not in "lsz":
                            w = w[:-1]
                        elif self.measure(w) == 1 and self.short_end(w):
                            w += "e"
                    break
        if w.endswith("y") and "v" in self.vowels(w[:-1]):
            w = w[:-1] + "i"
        w = self.replaced(w, self.STEP2, 0)
        w = self.replaced(w, self.STEP3, 0)
        for end in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(end):
                base = w[: -len(end)]
                if self.measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                    w = base
                break
        if w.endswith("e") and (self.measure(w[:-1]) > 1 or self.measure(w[:-1]) == 1 and not self.short_end(w[:-1])):
            w = w[:-1]
        return w[:-1] if w.endswith("ll") and self.measure(w) > 1 else w


def stem_table(terms: DataFrame) -> DataFrame:
    """term, stem of the distinct terms (term): stems are computed once per distinct word, however often it occurs."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        porter = Porter()
        return words.map(porter.stem)

    return terms.select("term").distinct().withColumn("stem", stem("term"))


def detected_aspects(text: Column) -> Column:
    """Names of the aspects of which a trigger stands anywhere in the text, in the aspects' order."""

    def told(low: Column) -> Column:
        names = (F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in keys)), F.lit(name)) for name, keys in ASPECTS.items())
        return F.filter(F.array(*names), lambda x: x.isNotNull())

    # As the variable of a lambda, the lower-case text is made once, not for each trigger.
    return F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), told), 0)


def named(value: Column, names: dict[str, str]) -> Column:
    """Display name of a value; the value itself if it has none."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value)


def snippet(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))


def aspect_name(a: Column) -> Column:
    return F.lower(F.trim(F.substring_index(a, ":", 1)))


def parsed_aspects(aspects: Column) -> Column:
    """name:polarity strings as structs; polarity is null without a colon; blanks are dropped."""
    kept = F.filter(F.transform(F.coalesce(aspects, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    return F.transform(kept, lambda a: F.struct(F.substring_index(a, ":", 1).alias("name"), F.when(F.contains(a, F.lit(":")), a.substr(F.instr(a, ":") + 1, F.length(a))).alias("polarity")))
