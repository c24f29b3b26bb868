import random

import pytest

from quernel.llm import frequency, tokens

pytest.importorskip("public_tokenizers")

ODD = ["I'll go'S don't ''s -'s 12½ ²x Straße ÀÉ́ é́", "ΑΣ ΣΑΣ ΌΣΟΣ.", "<|endoftext|>hello<|startoftext|> <|x|>", "日本語テキスト 한국어 हिन्दी क्षत्रिय", "a\x1cb\x85c d　e\xa0f\x0bg\x0ch", "", None, "x" * 5000, "İstanbul ŉ ǅ K Å", "emoji 😀😀 👩‍👩‍👧 — “quotes”", "\x00\x01 ​ ﻿ ª º µ ß ẞ ſ ÿ Ÿ Ŀ ŀ"]


@pytest.mark.parametrize("hot", [0, 5, 1 << 19])
def test_counts_equal_the_library(as_table, monkeypatch, hot):
    monkeypatch.setattr(frequency.join_frequencies, "__defaults__", (hot, None))
    rnd = random.Random(1)
    alphabet = "aAbßÉé's ’.-1½²\n\t\xa0ſΣσςЖж語"
    rows = list(enumerate([*ODD, *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(150))]))
    rows += [(0, ODD[0]), (0, "another text of the same id")]
    tokenizer = tokens.load(tokens.tokenizer_path())
    expected = sorted((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = tokens.count_text_tokens(as_table(rows), limit=100).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_empty_table(as_table):
    assert tokens.count_text_tokens(as_table([], name="none")).count() == 0
