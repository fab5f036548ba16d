"""Full-text search over postings: query grammar, matching, BM25 and snippets.

A written index holds postings, one row a token: document, column, position, term. A query's phrases are found in one
pass over the postings of its terms and one aggregation, whatever their number. Without a written index, texts are
scanned: each document's phrases are found within its row, and nothing but the result is shuffled. Either way the boolean
expression is then a column expression over each document's phrase counts. Scores need the corpus' row count and token
total (kept with the index) and each phrase's document count, all scalar subqueries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

COLUMNS = ("title", "transcript_text", "summary_text", "topic_tags")
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
SNIPPET_COLUMN, SNIPPET_TOKENS = "transcript_text", 18


class QuerySyntaxError(ValueError):
    """A query that the grammar doesn't admit."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] | None = None


@dataclass
class Node:
    """op: phrase (value: number of a phrase), near (phrase numbers, distance), and, or, not, empty."""

    op: str
    parts: list[Node] = field(default_factory=list)
    value: int | None = None
    near: tuple[tuple[int, ...], int] | None = None


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:+*^,-]))')
_FOLD = str.maketrans(*X.fold_table())


def fold(word: str) -> list[str]:
    """Search tokens of a string, as text columns are tokenised."""
    import regex

    return regex.findall(X.TOKEN, word.translate(_FOLD).lower())


class _Parser:
    def __init__(self, query: str):
        self.words: list[tuple[str, str]] = []
        at, query = 0, query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise QuerySyntaxError(f"syntax error near {query[at : at + 10]!r}")
            kind = "string" if m[1] is not None else "bare" if m[2] is not None else m[3]
            self.words.append((kind, m[1].replace('""', '"') if m[1] is not None else m[2] or m[3]))
            at = m.end()
        self.at, self.phrases = 0, []
        if not self.words:
            raise QuerySyntaxError("empty query")

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.words[self.at + ahead] if self.at + ahead < len(self.words) else ("end", "")

    def take(self, kind: str | None = None) -> str:
        got, word = self.peek()
        if kind and got != kind or got == "end":
            raise QuerySyntaxError(f"expected {kind}, found {word or 'the end'}")
        self.at += 1
        return word

    def parse(self) -> Node:
        node = self.level(0, None)
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r}")
        return node

    def level(self, depth: int, columns) -> Node:
        """OR, AND, NOT bind ever tighter; phrases side by side tightest of all."""
        if depth == 3:
            return self.side_by_side(columns)
        word = ("OR", "AND", "NOT")[depth]
        node = self.level(depth + 1, columns)
        while self.peek() == ("bare", word):
            self.take()
            node = Node(word.lower(), [node, self.level(depth + 1, columns)])
        return node

    def side_by_side(self, columns) -> Node:
        node = self.unit(columns)
        while self.peek()[0] in ("string", "bare", "(", "{", "^", "-") and self.peek()[1] not in ("AND", "OR", "NOT"):
            node = Node("and", [node, self.unit(columns)])
        return node

    def unit(self, columns) -> Node:
        kind, word = self.peek()
        negated = kind == "-"
        if negated:
            self.take()
            kind, word = self.peek()
            if kind != "{" and self.peek(1)[0] != ":":
                raise QuerySyntaxError("a minus must precede columns")
        if kind == "{" or kind in ("bare", "string") and self.peek(1)[0] == ":":
            names = []
            if kind == "{":
                self.take()
                while self.peek()[0] != "}":
                    names.append(self.take("bare" if self.peek()[0] == "bare" else "string"))
                self.take()
            else:
                names.append(self.take())
            self.take(":")
            if unknown := [n for n in names if n.lower() not in COLUMNS]:
                raise QuerySyntaxError(f"no such column: {unknown[0]}")
            chosen = {n.lower() for n in names}
            chosen = set(COLUMNS) - chosen if negated else chosen
            own = tuple(c for c in COLUMNS if c in chosen and (columns is None or c in columns))
            return self.unit(own)
        if kind == "(":
            self.take()
            node = self.level(0, columns)
            self.take(")")
            return node
        if kind == "bare" and word == "NEAR" and self.peek(1)[0] == "(":
            self.at += 2
            inside = []
            while self.peek()[0] in ("string", "bare", "^"):
                inside.append(self.phrase(columns))
            distance = 10
            if self.peek()[0] == ",":
                self.take()
                if not (number := self.take("bare")).isdigit():
                    raise QuerySyntaxError("NEAR needs a number")
                distance = int(number)
            self.take(")")
            inside = [p for p in inside if p is not None]
            return Node("near", near=(tuple(inside), distance)) if len(inside) > 1 else self._one(inside[0] if inside else None)
        return self._one(self.phrase(columns))

    def _one(self, number: int | None) -> Node:
        return Node("empty") if number is None else Node("phrase", value=number)

    def phrase(self, columns) -> int | None:
        initial = self.peek()[0] == "^"
        if initial:
            self.take()
        terms, prefix = [], False
        while True:
            kind, word = self.peek()
            if kind not in ("string", "bare") or kind == "bare" and word in ("AND", "OR", "NOT"):
                raise QuerySyntaxError(f"unexpected {word or 'end'!r}")
            self.take()
            terms += fold(word)
            if self.peek()[0] == "*":
                self.take()
                prefix = True
            if self.peek()[0] != "+":
                break
            self.take()
        if not terms:
            return None
        self.phrases.append(Phrase(tuple(terms), prefix, initial, columns))
        return len(self.phrases) - 1


def parse(query: str) -> tuple[Node, list[Phrase]]:
    parser = _Parser(query)
    return parser.parse(), parser.phrases


# --- the index ---------------------------------------------------------------------------------------------------


def indexed_text(conversations: DataFrame) -> DataFrame:
    """What is indexed: title, transcript, a summary's abstract, topic tags; nulls as empty."""
    abstract = F.coalesce(F.get_json_object("summary_json", "$.abstract_text"), F.lit("")) if "summary_json" in conversations.columns else F.lit("")
    tags = F.to_json("topic_tags") if "topic_tags" in conversations.columns else F.lit("[]")
    return conversations.select("conversation_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("transcript_text", F.lit("")).alias("transcript_text"), abstract.alias("summary_text"), F.coalesce(tags, F.lit("[]")).alias("topic_tags"))


def postings(texts: DataFrame) -> DataFrame:
    """conversation_id, col, pos, term."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), X.tokens(F.col(c)).alias("terms")) for c in COLUMNS])
    return texts.select("conversation_id", F.inline(each)).select("conversation_id", "col", F.posexplode("terms").alias("pos", "term"))


def once(df: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """df's kept columns and new ones that are computed once a row: a generator of one row stands between them and what
    uses them, which the optimizer would else copy them into, wherever they are named."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def lengths(texts: DataFrame) -> DataFrame:
    """conversation_id, n: tokens of all columns, 0 where there are none."""
    return texts.select("conversation_id", reduce(lambda a, b: a + b, [F.size(X.tokens(F.col(c))) for c in COLUMNS]).cast("long").alias("n"))


@dataclass
class FullTextIndex:
    """The postings and lengths of a snapshot; stays as it was built until it is built again. texts: scanned by searches
    instead of the postings, before the index is written."""

    postings: DataFrame
    lengths: DataFrame
    texts: DataFrame | None = None

    @classmethod
    def build(cls, conversations: DataFrame) -> FullTextIndex:
        texts = indexed_text(conversations)
        return cls(postings(texts), lengths(texts), texts)

    def write(self, path: str, partitions: int | None = None) -> None:
        """Postings sorted by term within files that each hold a range of terms, so that a query reads few row groups."""
        n = partitions or int(self.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.postings.repartitionByRange(n, "term", "conversation_id").sortWithinPartitions("term", "conversation_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def read(cls, spark, path: str) -> FullTextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """term, df, cf from postings."""
    return rows.groupBy("term").agg(F.countDistinct("conversation_id").alias("df"), F.count("*").alias("cf"))


def _places(phrases: list[Phrase]) -> Column:
    """For a posting, (phrase, place in it) wherever its term stands in a phrase."""
    found = []
    for number, phrase in enumerate(phrases):
        for place, term in enumerate(phrase.terms):
            last = place == len(phrase.terms) - 1
            hit = F.col("term").startswith(term) if phrase.prefix and last else F.col("term") == term
            if phrase.columns is not None:
                hit = hit & F.col("col").isin(*phrase.columns)
            if phrase.initial:
                hit = hit & (F.col("pos") == place)
            found.append(F.when(hit, F.struct(F.lit(number).alias("phrase"), F.lit(place).alias("place"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _wanted(phrases: list[Phrase]) -> Column:
    """A filter on the term alone, which reaches the scan."""
    whole = sorted({t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)})
    starts = sorted({p.terms[-1] for p in phrases if p.prefix})
    tests = ([F.col("term").isin(*whole)] if whole else []) + [F.col("term").startswith(s) for s in starts]
    return reduce(lambda a, b: a | b, tests)


def occurrences(rows: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """conversation_id, col, phrase, start: where each phrase stands."""
    size = F.create_map(*[F.lit(x) for i, p in enumerate(phrases) for x in (i, len(p.terms))])
    hits = rows.where(_wanted(phrases)).select("conversation_id", "col", "pos", F.inline(_places(phrases)))
    starts = hits.select("conversation_id", "col", "phrase", (F.col("pos") - F.col("place")).alias("start"), "place")
    if max(len(p.terms) for p in phrases) == 1:
        return starts.drop("place")
    return starts.groupBy("conversation_id", "col", "phrase", "start").agg(F.countDistinct("place").alias("n")).where(F.col("n") == size[F.col("phrase")]).drop("n")


def near(rows: DataFrame, phrases: tuple[int, ...], sizes: tuple[int, ...], distance: int) -> DataFrame:
    """Of occurrences (conversation_id, col, phrase, start), those that stand near one of every other phrase, in the same
    column: no more than distance tokens between the end of the first and the start of the last. One sorted sweep of each
    document forward, for the next of each phrase, and one back, for how far the groups before reach."""
    rows = rows.where(F.col("phrase").isin(*phrases))
    size = F.create_map(*[F.lit(x) for pair in zip(phrases, sizes, strict=True) for x in pair])[F.col("phrase")]
    column = Window.partitionBy("conversation_id", "col").orderBy("start")
    ahead, behind = column.rangeBetween(Window.currentRow, Window.unboundedFollowing), column.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.col("start") + size + distance
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.min(F.when(F.col("phrase") == p, F.col("start"))).over(ahead) <= reach, F.lit(False)) for p in phrases])
    reached = rows.withColumn("reach", F.when(whole, reach))
    return reached.withColumn("reach", F.max("reach").over(behind)).where("start <= reach").drop("reach")


def _count_of(phrase: int) -> Column:
    return F.size(F.filter("hits", lambda x: x["phrase"] == phrase)).alias(f"f{phrase}")


_HITS = "array<struct<col:string,phrase:int,start:int>>"


def _hits_in(tokens: Column, column: str, number: int, phrase: Phrase) -> Column:
    """Where a phrase stands in one column's tokens."""

    def start(term: Column, at: Column) -> Column:
        tests = []
        for place, word in enumerate(phrase.terms):
            found = term if place == 0 else F.get(tokens, at + place)
            tests.append(found.startswith(word) if phrase.prefix and place == len(phrase.terms) - 1 else found == word)
        if phrase.initial:
            tests.append(at == 0)
        return F.when(reduce(lambda a, b: a & b, tests), F.struct(F.lit(column).alias("col"), F.lit(number).alias("phrase"), at.alias("start")))

    return F.filter(F.transform(tokens, start), lambda x: x.isNotNull())


def _scanned(texts: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """conversation_id, n, hits of every document, each found within its row."""
    rows = once(texts, ["conversation_id"], **{c: X.tokens(F.col(c)) for c in COLUMNS})
    found = [_hits_in(F.col(c), c, i, p) for i, p in enumerate(phrases) for c in COLUMNS if p.columns is None or c in p.columns]
    hits = F.concat(*found).cast(_HITS) if found else F.array().cast(_HITS)
    return once(rows, ["conversation_id"], n=reduce(lambda a, b: a + b, [F.size(c) for c in COLUMNS]).cast("long"), hits=hits)


def matches(index: FullTextIndex, query: str) -> DataFrame:
    """conversation_id, score (negative, better ones lower), hits: (col, phrase, start) of each matching document."""
    node, phrases = parse(query)
    if not phrases:
        return index.lengths.where(F.lit(False)).select("conversation_id", F.lit(0.0).alias("score"), F.array().cast(_HITS).alias("hits"))
    counts = [_count_of(i) for i in range(len(phrases))]
    if index.texts is not None:
        every = _scanned(index.texts, phrases)
        docs = every.where(F.size("hits") > 0).select("*", *counts)
        # over the same rows, so that what was shuffled to make them is used again
        sizes = [F.coalesce(F.sum((c > 0).cast("long")), F.lit(0)) for c in counts]
        facts = every.select("n", "hits").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), *[x.alias(f"df{i}") for i, x in enumerate(sizes)])
        of = lambda name: facts.select(name).scalar()
    else:
        per_doc = occurrences(index.postings, phrases).groupBy("conversation_id").agg(F.collect_list(F.struct("col", "phrase", "start")).alias("hits"))
        docs = per_doc.select("*", *counts)
        freq = docs.agg(*[F.coalesce(F.sum((F.col(f"f{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(phrases))])
        corpus = index.lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
        of = lambda name: (freq if name.startswith("df") else corpus).select(name).scalar()
    # a phrase's document count is its own, whatever NEAR leaves of it
    for inside, distance in _nears(node):
        close = near(docs.select("conversation_id", F.inline("hits")), inside, tuple(len(phrases[p].terms) for p in inside), distance)
        left = close.groupBy("conversation_id").agg(*[F.count_if(F.col("phrase") == p).alias(f"near{p}") for p in inside])
        docs = docs.join(left, "conversation_id", "left").withColumns({f"f{p}": F.coalesce(f"near{p}", F.lit(0)) for p in inside})
    holds, counted = _condition(node)
    docs = docs.where(holds).select("*", *[of(c).alias(c) for c in ("n_docs", "n_tokens", *(f"df{i}" for i in range(len(phrases))))])
    if index.texts is None:
        docs = docs.join(index.lengths, "conversation_id")
    spread = K1 * (1 - B + B * F.col("n") / (F.col("n_tokens") / F.col("n_docs")))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        part = idf * (F.col(f"f{i}") * (K1 + 1)) / (F.col(f"f{i}") + spread)
        score = score + F.when(counted[i] & (F.col(f"f{i}") > 0), part).otherwise(0.0) if i in counted else score
    counts_now = F.array(*[counted.get(i, F.lit(False)) for i in range(len(phrases))])
    hits = F.filter("hits", lambda h: counts_now[h["phrase"]])  # only phrases that count here are marked in snippets
    return docs.select("conversation_id", (-score).alias("score"), hits.alias("hits"))


def _nears(node: Node) -> list[tuple[tuple[int, ...], int]]:
    own = [node.near] if node.near else []
    return own + [x for p in node.parts for x in _nears(p)]


def _condition(node: Node) -> tuple[Column, dict[int, Column]]:
    """Whether a document matches, and, for each phrase that can score, when it counts."""
    if node.op == "empty":
        return F.lit(False), {}
    if node.op in ("phrase", "near"):
        own = (node.value,) if node.op == "phrase" else node.near[0]
        holds = reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in own])
        return holds, {i: holds for i in own}
    left, right = map(_condition, node.parts)
    if node.op == "or":
        return left[0] | right[0], left[1] | right[1]
    # a side without tokens constrains nothing: it drops out of its AND
    if node.op == "and" and "empty" in (node.parts[0].op, node.parts[1].op):
        return right if node.parts[0].op == "empty" else left
    holds = left[0] & (right[0] if node.op == "and" else ~right[0])
    scoring = left[1] | (right[1] if node.op == "and" else {})
    return holds, {i: counted & holds for i, counted in scoring.items()}


# --- snippets ----------------------------------------------------------------------------------------------------


def snippet(text: str, hits: list[tuple[int, int, int]], most: int = SNIPPET_TOKENS, left: str = "[", right: str = "]", more: str = "…") -> str:
    """A stretch of at most so many tokens that covers most phrases, with the matches marked.

    hits: (start, tokens, phrase) in this text. Each match opens a window; a phrase counts 1000 once and 1 again; the
    window is moved so that its matches are central. A window from the start of the sentence before a match gets 100
    more, from the text's start 120 more.
    """
    import regex

    spans = [m.span() for m in regex.finditer(X.TOKEN, text.translate(_FOLD).lower())] if len(text.lower()) == len(text) else [m.span() for m in regex.finditer(X.TOKEN, text)]
    n = len(spans)
    hits = sorted(hits)
    if not n:
        return text

    def rate(at: int) -> tuple[int, int]:
        inside = [h for h in hits if at <= h[0] < at + most]
        kinds = {h[2] for h in inside}
        points = 1000 * len(kinds) + len(inside) - len(kinds)
        first, last = inside[0][0], inside[-1][0] + inside[-1][1]
        gap = most - (last - first)
        moved = first - (gap // 2 if gap >= 0 else -(-gap // 2))
        return points, max(0, min(moved, n - most))

    sentences = [0] + [k for k in range(1, n) if (before := text[: spans[k][0]].rstrip(" \t\n\r")) and before[-1] in ".:" and spans[k - 1][1] <= len(before)]
    best, start = 0, 0
    for at, _, _ in hits:
        points, moved = rate(at)
        if points > best:
            best, start = points, moved
        if n > most:
            earlier = [s for s in sentences if s < at]
            if earlier and sentences[sentences.index(earlier[-1])] < at and at not in sentences:
                s = earlier[-1]
                inside = [h for h in hits if s <= h[0] < s + most]
                kinds = {h[2] for h in inside}
                points = 1000 * len(kinds) + len(inside) - len(kinds) + (120 if s == 0 else 100)
                if points > best:
                    best, start = points, s
    end = min(n, start + most) - 1
    marked: list[list[int]] = []
    for at, size, _ in hits:
        if at > end or at + size - 1 < start:
            continue
        if marked and at <= marked[-1][1]:
            marked[-1][1] = max(marked[-1][1], at + size - 1)
        else:
            marked.append([at, at + size - 1])
    low, high = (0 if start == 0 else spans[start][0]), (len(text) if end == n - 1 else spans[end][1])
    out, at = [more if start > 0 else ""], low
    for a, b in marked:
        a, b = max(a, start), min(b, end)
        out += [text[at : spans[a][0]], left, text[spans[a][0] : spans[b][1]], right]
        at = spans[b][1]
    out += [text[at:high], more if end < n - 1 else ""]
    return "".join(out)


def snippet_col(text: Column, hits: Column, phrases: list[Phrase]) -> Column:
    """For the few rows that a search returns."""
    sizes = [len(p.terms) for p in phrases]

    def many(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([snippet(t or "", [(h["start"], sizes[h["phrase"]], h["phrase"]) for h in (f if f is not None else []) if h["col"] == SNIPPET_COLUMN]) for t, f in zip(texts, found, strict=True)], dtype=object)

    many.__annotations__ = {"texts": pd.Series, "found": pd.Series, "return": pd.Series}
    return F.pandas_udf(many, "string")(text, hits)
