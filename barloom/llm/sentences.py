"""Substring deduplication by sliding runs of sentences.

A text is cut into sentences behind line ends and behind . ! ? with closing quotes or brackets, if any, and white space after them. Sentences of more than
CUT_WORDS words are cut further, by content: of every CUT_WORDS neighbouring words of a sentence the one with the smallest hash begins a piece
(winnowing, Schleimer et al. 2003), so copies of a passage are cut alike inside, whatever stands around them, with or without marks. White
space stays with its piece, so the pieces join to the whole text again. "Sentence" below and in the counts that come out means such a piece; none
is longer than CUT_WORDS words. From every sentence the shortest run forward, and the shortest run backward, that is long enough is hashed: at least
`min_words` words in at least two sentences, or `lone_words` words in fewer. Any stretch of two or more sentences and `min_words` words that
two places share is then covered by shared runs from its first to its last sentence, and so is one long sentence. A passage of over 50 words
(min_words + 2 * CUT_WORDS - 1, and more) that stands in mid-sentence has its first common cut within its first CUT_WORDS words and its last within its last, and
goes between them: up to CUT_WORDS words at either end may stay.
Runs are joined globally by hash; of equal runs the first, by doc_id and place, stays, and every sentence that any other covers goes.

Runs compare by their words, whatever white space stands between them. Skew: inside each batch of documents only the first
of equal runs goes on to the shuffle, the others are marked on the spot, so a run that stands in a third of all documents reaches its
task once per batch.

Defined results: a null text stays null, an empty one stays empty. A null doc_id comes first. Rows equal in doc_id and text are one
occurrence and keep the same sentences. A text whose sentences all go becomes empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import only

SENTENCE_END = re.compile(r"""\n(?=[^\n])|[.!?]["'”’»)\]]*\s+(?=\S)""")
WORD = re.compile(r"\S+")
#: Words among which one begins a piece. A passage of 51 words keeps 51 - 2 * 16 + 1 = 20 between its first and last common cut.
CUT_WORDS = 16
NO_ID = -(1 << 63)
#: Runs that are compared inside a batch before the shuffle.
BATCH_RUNS = 150_000


def split_sentences(text: str) -> list[str]:
    """Sentences, long ones in pieces, with the white space behind them; joined, they are the text."""
    out, start = [], 0
    for end in [*(m.end() for m in SENTENCE_END.finditer(text or "")), len(text or "")]:
        if end > start:
            out += pieces(text[start:end])
            start = end
    return out


def pieces(sentence: str) -> list[str]:
    """A sentence cut before the word with the smallest hash, the first of equal ones, of every CUT_WORDS neighbouring words."""
    if len(sentence) < 2 * CUT_WORDS + 1:
        return [sentence]
    words = sentence.split()
    if len(words) <= CUT_WORDS:
        return [sentence]
    h = [xxhash.xxh32_intdigest(w) for w in words]
    least, cuts = -1, []
    for i in range(len(h) - CUT_WORDS + 1):
        end = i + CUT_WORDS
        if least < i:
            least = h.index(min(h[i:end]), i)
        elif h[end - 1] < h[least]:
            least = end - 1
        else:
            continue
        cuts.append(least)
    starts = [m.start() for m in WORD.finditer(sentence)]
    at = [0, *(starts[c] for c in cuts if c), len(sentence)]
    return [sentence[a:b] for a, b in zip(at, at[1:])]


def runs(words: list[int], min_words: int, lone_words: int) -> list[tuple[int, int]]:
    """Runs [i, j) over sentences with so many words: the shortest long enough from each start and to each end."""
    n, out, done = len(words), set(), [0]
    for w in words:
        done.append(done[-1] + w)
    enough = lambda i, j: (t := done[j] - done[i]) >= lone_words or t >= min_words and j - i >= 2
    j = 0
    for i in range(n):
        j = max(j, i + 1)
        while j < n and not enough(i, j):
            j += 1
        if not enough(i, j):
            break
        out.add((i, j))
    i = n - 1
    for j in range(n, 0, -1):
        i = min(i, j - 1)
        while i > 0 and not enough(i, j):
            i -= 1
        if not enough(i, j):
            break
        out.add((i, j))
    return sorted(out)


def _found(doc: int, th: int, text: str, min_words: int, lone_words: int) -> list[tuple]:
    sentences = split_sentences(text)
    words = [s.split() for s in sentences]
    plain = [" ".join(w) for w in words]
    out = []
    for i, j in runs([len(w) for w in words], min_words, lone_words):
        h = xxhash.xxh3_128_digest(" ".join(plain[i:j]))
        out.append((h, doc, th, i, j))
    return out


def repeated_runs(docs: DataFrame, min_words: int, lone_words: int) -> DataFrame:
    """doc, th, i, j of every run of which an equal one comes before. docs: doc, th, text."""
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pd.DataFrame:
            rows.sort()
            a = [int.from_bytes(r[0][:8], "little", signed=True) for r in rows]
            b = [int.from_bytes(r[0][8:], "little", signed=True) for r in rows]
            again = []
            # What follows the first of its kind in this batch is known to repeat; equal rows (same doc, th, i) stay equal.
            first: dict[bytes, tuple] = {}
            for r in rows:
                again.append(first.setdefault(r[0], r[1:4]) != r[1:4])
            return pd.DataFrame({"a": a, "b": b, "doc": [r[1] for r in rows], "th": [r[2] for r in rows], "i": [r[3] for r in rows],
                                 "j": [r[4] for r in rows], "again": again})

        for pdf in batches:
            for doc, th, text in zip(pdf["doc"], pdf["th"], pdf["text"]):
                held += _found(doc, th, text, min_words, lone_words)
                if len(held) >= BATCH_RUNS:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    marked = docs.select("doc", "th", "text").mapInPandas(mark, "a long, b long, doc long, th long, i int, j int, again boolean")
    # Known repeats are dealt out by document, the others meet by hash.
    place = Window.partitionBy("x", "y").orderBy("doc", "th", "i")
    keyed = marked.select("doc", "th", "i", "j", "again", F.when(F.col("again"), F.xxhash64("doc", "i", "j")).otherwise(F.col("a")).alias("x"),
                          F.when(F.col("again"), F.lit(None)).otherwise(F.col("b")).alias("y"))
    # rank() gives equal rows the same rank: rows equal in doc_id and text are one occurrence.
    return keyed.withColumn("rank", F.rank().over(place)).filter("again or rank > 1").select("doc", "th", "i", "j")


def _kept(text: str | None, gone: list) -> tuple[str | None, int, int, int]:
    if not text:
        return text, 0, 0, 0
    sentences = split_sentences(text)
    out = set()
    for i, j in gone:
        out.update(range(i, j))
    return ("".join(s for k, s in enumerate(sentences) if k not in out), len(sentences), len(out),
            sum(len(sentences[k].split()) for k in out))


def deduplicated(docs: DataFrame, min_words: int = 20, lone_words: int = 50) -> DataFrame:
    """docs with text as it remains and the columns n_sentences, removed_sentences, removed_words (longs)."""
    keys = docs.withColumns({"__doc": F.coalesce(F.col("`doc_id`"), F.lit(NO_ID)), "__th": F.xxhash64("text")})
    sources = only(keys, doc="__doc", th="__th", text="text").filter("text is not null and text <> ''")
    gone = (repeated_runs(sources, min_words, lone_words)
            .groupBy(F.col("doc").alias("__doc"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("i", "j")).alias("__gone")))
    joined = keys.join(gone, ["__doc", "__th"], "left")
    schema = "text string, n_sentences long, removed_sentences long, removed_words long"

    @F.pandas_udf(schema)
    def kept(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [_kept(t, [] if s is None else [(x["i"], x["j"]) for x in s]) for t, s in zip(text, spans)]
        return pd.DataFrame(rows, columns=["text", "n_sentences", "removed_sentences", "removed_words"])

    out = joined.withColumn("__kept", kept(F.col("text"), F.col("__gone")))
    own = [F.col("__kept.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, "__kept.n_sentences", "__kept.removed_sentences", "__kept.removed_words")
