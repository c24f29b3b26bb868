"""Schemas of raw records and of indexed documents."""

from __future__ import annotations

#: A raw record; aspects are an object or a list in JSON, so their text is kept.
RAW = """
doc_id string, source_platform string, source_url string, content_type string,
content struct<thread_title: string, main_text: string, reply_text: string>,
labels struct<agents: array<string>, polarity: string, subjectivity: string, aspects: string, sarcasm: string>,
platform_context struct<subreddit: string>, author struct<username: string>,
timestamps struct<created_at: string>, engagement struct<upvotes: int, num_replies: int>
"""

#: An issue of a code platform, before it becomes a raw record.
ISSUE = """
doc_id string, source_platform string, source_url string, content_type string,
content struct<thread_title: string, main_text: string, reply_text: string>,
platform_context struct<repo: string>, author struct<username: string>,
timestamps struct<created_at: string>, engagement struct<reactions_total: int, num_comments: int>
"""

DOCUMENT = """
doc_id string, title string, text string, source string, url string, content_type string, tools array<string>,
sentiment string, subjectivity string, aspects array<string>, sarcasm string, subreddit string, author string,
date timestamp, upvotes int, num_replies int, vector array<float>
"""
