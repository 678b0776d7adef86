"""Terminology linking: bounded dictionary matches in texts and a budgeted context per text.

Texts are cut into tokens once; tokens meet terms of one token in an equi-join, phrases are found by
a positional index of neighbouring tokens, so work grows with the texts and not with texts times
terms, nor with the longest phrase. The term table is measured first: a small one is broadcast, a
large one is joined by shuffle.

Offsets count code points of the normalised text (composed and case folded).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import broadcast_if_small, cut_lineage, discard, short_batches, spread, written

# Particles that may follow a term, the particles of the older glossary filter,
# the build prefix of items, and the slot cues of abilities.
PARTICLES = (
    "긴한데", "인데요", "이라고", "이지만", "이라서", "이어서", "라고", "에게",
    "한테", "으로", "에서", "부터", "까지", "처럼", "보다", "하고", "이랑",
    "인데", "이나", "이면", "이고", "이야", "이네", "은", "는", "이", "가",
    "을", "를", "에", "로", "와", "과", "도", "만", "의", "랑", "나", "긴",
)
GLOSSARY_PARTICLES = (
    "은", "는", "이", "가", "을", "를", "에", "에서", "에게", "한테", "으로", "로",
    "와", "과", "도", "만", "의", "부터", "까지", "처럼", "보다", "하고", "랑", "이나", "나",
    "라고", "이라고",
)
BUILD_PREFIX = "선"
SLOT_CUES = {
    "p": ("p", "패시브", "기본 지속 효과"),
    "q": ("q",),
    "w": ("w",),
    "e": ("e",),
    "r": ("r", "궁", "궁극기"),
}
COMPACT_KEY = 4
OFFICIAL = ("official_name", "concept_name")

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_WORD = re.compile(r"[^\W_]+")
_BATCH = 50_000
#: Terms in bytes that may be sent to every task as a prefix tree, which takes some 200 times as much memory.
TREE_BYTES = 1 << 20
#: Terms in bytes, with some room for each, that may be sent to every task as a set.
SET_BYTES = 8 << 20


def _by_last(particles: Sequence[str]) -> dict[str, list[str]]:
    table: dict[str, list[str]] = {}
    for p in particles:
        table.setdefault(p[-1], []).append(p)
    return table


def _token_starts(text: str) -> Iterator[tuple[int, str]]:
    """Tokens that a match may start at: not right after a letter or digit."""
    for found in _TOKEN.finditer(text):
        start, token = found.start(), found.group()
        if token[0].isalnum() or start == 0 or not text[start - 1].isalnum():
            yield start, token


def _explode_texts(texts: DataFrame, rows_of_text, schema: T.StructType) -> DataFrame:
    """Arrow map from (id, text) to id and the tuples that ``rows_of_text`` yields."""
    fields = schema.fields[1:]
    known = {"integer": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array": pa.list_(pa.int32())}
    kinds = [known[f.dataType.typeName()] for f in fields]

    def convert(batches):
        for batch in batches:
            ids, texts_ = batch.column(0), batch.column(1)
            at: list[int] = []
            rows: list[tuple] = []

            def flush():
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *arrays], names=schema.names)

            for i in range(batch.num_rows):
                text = texts_[i].as_py()
                if text is None:
                    continue
                found = iter(rows_of_text(text))
                while True:
                    before = len(rows)
                    rows.extend(islice(found, _BATCH - before))
                    at += [i] * (len(rows) - before)
                    if len(rows) < _BATCH:
                        break
                    yield flush()
                    at, rows = [], []
            if at:
                yield flush()

    short_batches(texts.sparkSession)
    return spread(texts).mapInArrow(convert, schema)


def normalized_texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(id_col).alias("text_id"), tx.dictionary_key(text_col, trimmed=False).alias("norm"))


def _schema(texts: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([texts.schema["text_id"], *[T.StructField(n, t) for n, t in fields]])


def _tail(particles: Sequence[str]) -> re.Pattern:
    """What may follow a match that ends in a sign: nothing, a boundary, or a particle and a boundary."""
    return re.compile(rf"(?:{'|'.join(particles)})?(?![^\W_])")


def _words_sent(words: DataFrame, column: str) -> Callable[[], frozenset[str] | None]:
    """The words as a set sent to every task, or None where they were measured to be too many."""
    distinct = words.select(column).distinct()
    weight, rows = distinct.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)), F.count(F.lit(1))).first()
    if weight + 64 * rows > SET_BYTES:
        return lambda: None
    shared = words.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in distinct.collect()))
    return lambda: shared.value


def _keys_in(particles: Sequence[str], wanted: Callable[[], frozenset[str] | None]) -> Callable[[str], Iterable[tuple[int, str]]]:
    """What ``token_keys`` gives for one text."""
    endings, tail = _by_last(particles), _tail(particles).pattern
    # A sign counts only where no letter or digit stands before it and a match may end after it.
    usable = re.compile(rf"[^\W_]+|(?<![^\W_])(?:[^\w\s]|_)(?={tail})")
    last = re.compile(f"[{''.join(map(re.escape, endings))}]")

    def with_particles(text: str, only: frozenset[str] | None):
        for start, token in _token_starts(text):
            for p in endings.get(token[-1], ()):
                if len(token) > len(p) and token.endswith(p) and (only is None or token[: -len(p)] in only):
                    yield start, token[: -len(p)]

    def rows(text: str):
        only = wanted()
        if only is not None and not only:
            return ()
        found = usable.finditer(text)
        whole = ((m.start(), m.group()) for m in found) if only is None else ((m.start(), m.group()) for m in found if m.group() in only)
        return chain(whole, with_particles(text, only)) if last.search(text) else whole

    return rows


def token_keys(texts: DataFrame, particles: Sequence[str] = PARTICLES, wanted: Callable[[], frozenset[str] | None] = lambda: None) -> DataFrame:
    """One row per token that may start and end a match, and per token without a particle; no text travels along.

    With ``wanted`` only tokens of that set are given.
    """
    return _explode_texts(texts, _keys_in(particles, wanted), _schema(texts, ("start", T.IntegerType()), ("key", T.StringType())))


def token_places(texts: DataFrame, particles: Sequence[str] = PARTICLES, wanted: Callable[[], frozenset[str] | None] = lambda: None) -> DataFrame:
    """The rows of ``token_keys`` with those of one key in one text as one row that lists their starts."""
    keys_in = _keys_in(particles, wanted)

    def rows(text: str):
        places: dict[str, list[int]] = {}
        for start, key in keys_in(text):
            places.setdefault(key, []).append(start)
        return places.items()

    return _explode_texts(texts, rows, _schema(texts, ("key", T.StringType()), ("starts", T.ArrayType(T.IntegerType()))))


def token_pairs(texts: DataFrame, particles: Sequence[str] = PARTICLES, wanted: Callable[[], frozenset[str] | None] = lambda: None) -> DataFrame:
    """Postings of neighbouring tokens with what parts them: text_id, pos, start, pair, begins, ends.

    ``pos`` numbers the tokens of a text; ``begins`` and ``ends`` say whether a match may start with the first and stop
    with the second. A second token is also given without each particle, with which only a match may end: ``inner`` is false.
    With ``wanted`` only pairs of that set are given.
    """
    endings, tail = _by_last(particles), _tail(particles)

    def rows(text: str):
        only = wanted()
        if only is not None and not only:
            return
        start = None
        for pos, found in enumerate(_TOKEN.finditer(text), -1):
            at, until = found.span()
            if start is not None:
                pair = text[start:until]
                here = only is None or pair in only
                cut = endings.get(text[until - 1], ())
                if here or cut:
                    begins = text[start].isalnum() or start == 0 or not text[start - 1].isalnum()
                    if here:
                        yield pos, start, pair, begins, text[at].isalnum() or bool(tail.match(text, until)), True
                    for p in cut:
                        if until - at > len(p) and text.endswith(p, at, until) and (only is None or pair[: -len(p)] in only):
                            yield pos, start, pair[: -len(p)], begins, True, False
            start = at

    shape = _schema(
        texts, ("pos", T.IntegerType()), ("start", T.IntegerType()), ("pair", T.StringType()), ("begins", T.BooleanType()), ("ends", T.BooleanType()), ("inner", T.BooleanType())
    )
    return _explode_texts(texts, rows, shape)


def _pairs_of(terms: DataFrame) -> DataFrame:
    """source_id, term and the pairs of neighbouring tokens of each term of two or more tokens."""

    def convert(batches):
        for batch in batches:
            names, at, pairs = batch.column(1).to_pylist(), [], []
            for i, term in enumerate(names):
                tokens = list(_TOKEN.finditer(term))
                if len(tokens) > 1:
                    at.append(i)
                    pairs.append([term[x.start() : y.end()] for x, y in zip(tokens, tokens[1:])])
            kept = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(pairs, pa.list_(pa.string()))], names=["source_id", "term", "pairs"])

    shape = T.StructType([terms.schema["source_id"], T.StructField("term", T.StringType()), T.StructField("pairs", T.ArrayType(T.StringType()))])
    return terms.select("source_id", F.col("norm").alias("term")).mapInArrow(convert, shape)


def phrase_matches(texts: DataFrame, phrases: DataFrame, particles: Sequence[str] = PARTICLES) -> DataFrame:
    """Occurrences of ``phrases`` (source_id, term, pairs) by a positional index of the texts.

    Postings of pairs that some phrase has are written once. The pair of a phrase that stands in the fewest places says where
    the phrase may begin; the others are looked up there by position, and a phrase occurs where all its pairs are met.
    """
    needed = phrases.select("source_id", "term", F.size("pairs").alias("m"), F.posexplode("pairs").alias("i", "pair"))
    postings = cut_lineage(token_pairs(texts, particles, _words_sent(needed, "pair")).join(broadcast_if_small(needed.select("pair").distinct()), "pair"))
    places = postings.groupBy("pair").agg(F.count(F.lit(1)).alias("places"))
    counted = needed.join(broadcast_if_small(places), "pair")
    rarest = counted.groupBy("source_id", "term", "m").agg(F.min_by(F.struct("i", "pair"), F.struct("places", "i")).alias("a"), F.count(F.lit(1)).alias("known"))
    rarest = rarest.filter("known = m").select("source_id", "term", "m", F.col("a.i").alias("i"), F.col("a.pair").alias("pair"))

    def fits(p: DataFrame) -> DataFrame:
        """Postings at their place in a phrase: only its first pair begins it, only its last one ends it."""
        return p.filter((F.col("i") > 0) | F.col("begins")).filter(F.when(F.col("i") == F.col("m") - 1, F.col("ends")).otherwise(F.col("inner")))

    tried = fits(postings.join(broadcast_if_small(rarest), "pair")).withColumn("origin", F.col("pos") - F.col("i"))
    whole = ["text_id", "source_id", "term", "m", "origin"]
    single = tried.filter("m = 1").select("text_id", "source_id", "term", "start").distinct()
    wanted = tried.filter("m > 1").select(*whole).distinct().join(broadcast_if_small(needed.select("source_id", "term", "i", "pair")), ["source_id", "term"])
    wanted = wanted.withColumn("pos", F.col("origin") + F.col("i"))
    met = fits(wanted.join(postings, ["text_id", "pos", "pair"])).groupBy(*whole).agg(
        F.count_distinct("i").alias("n"), F.min(F.when(F.col("i") == 0, F.col("start"))).alias("start")
    )
    found = single.unionByName(met.filter("n = m").select("text_id", "source_id", "term", "start"))
    return found.select("text_id", "source_id", "start", (F.col("start") + F.length("term")).cast("int").alias("end"))


def _first_token(terms: DataFrame) -> DataFrame:
    """Add the first token of each normalised term, as the tokenizer sees it."""

    def convert(batches):
        for batch in batches:
            found = (_TOKEN.match(t or "") for t in batch.column(batch.schema.get_field_index("norm")).to_pylist())
            anchors = pa.array([m.group() if m else None for m in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, anchors], names=[*batch.schema.names, "anchor"])

    return terms.mapInArrow(convert, T.StructType([*terms.schema.fields, T.StructField("anchor", T.StringType())]))


def prepared_terms(records: DataFrame, id_col: str = "source_id", term_col: str = "term") -> DataFrame:
    """Distinct (id, normalised term) rows with their first token, written once as they are read often."""
    rows = records.select(F.col(id_col).alias("source_id"), tx.dictionary_key(term_col).alias("norm"))
    return cut_lineage(_first_token(rows.filter(F.length("norm") > 0).distinct()))


def bounded_matches(texts: DataFrame, terms: DataFrame, particles: Sequence[str] = PARTICLES) -> DataFrame:
    """Every occurrence of a term that starts and ends at a boundary, or ends before a particle.

    ``texts`` has (text_id, norm), ``terms`` comes from ``prepared_terms``; the result has
    (text_id, source_id, start, end) with the particle left out of the span.
    """
    listed = terms.filter("norm = anchor").select("source_id", F.col("norm").alias("key"))
    tokens = token_keys(texts, particles, _words_sent(listed, "key"))
    ends = (F.col("start") + F.length("key")).cast("int")
    single = tokens.join(broadcast_if_small(listed), "key").select("text_id", "source_id", "start", ends.alias("end"))
    phrases = cut_lineage(_pairs_of(terms.filter("norm <> anchor")))
    return single if phrases.isEmpty() else single.unionByName(phrase_matches(texts, phrases, particles))


def match_places(texts: DataFrame, terms: DataFrame, particles: Sequence[str] = PARTICLES) -> DataFrame:
    """The rows of ``bounded_matches`` with those of one term in one text as one row: text_id, source_id, size, starts."""
    listed = terms.filter("norm = anchor").select("source_id", F.col("norm").alias("key"))
    tokens = token_places(texts, particles, _words_sent(listed, "key"))
    single = tokens.join(broadcast_if_small(listed), "key").select("text_id", "source_id", F.length("key").alias("size"), "starts")
    phrases = cut_lineage(_pairs_of(terms.filter("norm <> anchor")))
    if phrases.isEmpty():
        return single
    met = phrase_matches(texts, phrases, particles).groupBy("text_id", "source_id", (F.col("end") - F.col("start")).alias("size"))
    return single.unionByName(met.agg(F.collect_list("start").alias("starts")))


def _skip_space(text: str, start: int, wanted: str) -> int | None:
    """Where ``wanted`` ends when whitespace in ``text`` is skipped; None if it does not fit."""
    at = start
    for character in wanted:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text) or text[at] != character:
            return None
        at += 1
    return at


def space_free_matches(texts: DataFrame, terms: DataFrame, particles: Sequence[str] = PARTICLES) -> DataFrame:
    """Occurrences of multi-word terms when blanks are ignored, e.g. written as one word.

    A match may also start in blanks before the word, one row for each blank that follows a
    boundary. Candidates share the first characters; they are then checked once per text.
    """
    compact = terms.withColumn("compact", tx.remove_whitespace("norm")).filter(F.length("compact") >= COMPACT_KEY)

    def rows(text: str):
        for start, _ in _token_starts(text):
            key, at = [], start
            while at < len(text) and len(key) < COMPACT_KEY:
                if not text[at].isspace():
                    key.append(text[at])
                at += 1
            if len(key) == COMPACT_KEY:
                yield start, "".join(key)

    keyed = _explode_texts(texts, rows, _schema(texts, ("start", T.IntegerType()), ("key", T.StringType())))
    listed = compact.select("source_id", "compact", F.substring("compact", 1, COMPACT_KEY).alias("key"))
    candidates = keyed.join(broadcast_if_small(listed), "key").groupBy("text_id").agg(
        F.collect_list(F.struct("start", "source_id", "compact")).alias("tries")
    )
    tail = re.compile(rf"(?:{'|'.join(particles)})?(?![^\W_])")
    source_type = terms.schema["source_id"].dataType
    found_type = T.ArrayType(T.StructType([
        T.StructField("source_id", source_type), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    ]))

    @F.pandas_udf(found_type)
    def verify(norms, tries):
        out = []
        for text, wanted in zip(norms, tries):
            found = []
            for t in wanted:
                end = _skip_space(text, t["start"], t["compact"])
                if end is None or not tail.match(text, end):
                    continue
                start = t["start"]
                found.append({"source_id": t["source_id"], "start": start, "end": end})
                while start > 0 and text[start - 1].isspace() and (start == 1 or not text[start - 2].isalnum()):
                    start -= 1
                    found.append({"source_id": t["source_id"], "start": start, "end": end})
            out.append(found)
        return pd.Series(out)

    return (
        candidates.join(texts, "text_id").select("text_id", F.explode(verify("norm", "tries")).alias("m"))
        .select("text_id", "m.source_id", "m.start", "m.end")
    )


def _fewest_pieces(size: int, ends_of: Callable[[int], Iterable[int]]) -> tuple[list[int | None], list[int]]:
    """For each place of a word: pieces of the shortest chain that ends there, and where its last piece starts (first on ties)."""
    pieces: list[int | None] = [0, *[None] * size]
    came = [0] * (size + 1)
    for i in range(size):
        if pieces[i] is None:
            continue
        for j in ends_of(i):
            if pieces[j] is None or pieces[i] + 1 < pieces[j]:
                pieces[j], came[j] = pieces[i] + 1, i
    return pieces, came


def _best_chain(word: str, ends_of: Callable[[int], Iterable[int]], particles: Sequence[str]) -> list[dict] | None:
    """Shortest chain of two or more pieces over the word or the word less one particle; one walk serves all of them."""
    pieces, came = _fewest_pieces(len(word), ends_of)
    stops = [len(word), *[len(word) - len(p) for p in particles if len(word) > len(p) and word.endswith(p)]]
    stops = [s for s in stops if (pieces[s] or 0) >= 2]
    if not stops:
        return None
    at, chain = min(stops, key=lambda s: pieces[s]), []
    while at:
        chain.append({"i": came[at], "j": at})
        at = came[at]
    return chain[::-1]


def _prefix_tree(words: Iterable[str]) -> dict:
    """Words as nested dictionaries of characters; the empty key marks where a word ends."""
    root: dict = {}
    for word in words:
        node = root
        for character in word:
            node = node.setdefault(character, {})
        node[""] = node
    return root


def _ends_in(tree: dict, word: str) -> Callable[[int], Iterator[int]]:
    def ends_of(i: int) -> Iterator[int]:
        node = tree
        for j in range(i, len(word)):
            node = node.get(word[j])
            if node is None:
                return
            if "" in node:
                yield j + 1

    return ends_of


_CHAIN = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


def _chains_by_tree(words: DataFrame, vocabulary: DataFrame, particles: Sequence[str]) -> DataFrame:
    """Chains of each word by one walk of a prefix tree; the caller has measured ``vocabulary``."""
    shared = words.sparkSession.sparkContext.broadcast([r.piece for r in vocabulary.collect()])

    @F.pandas_udf(_CHAIN)
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = _prefix_tree(shared.value)
        for batch in batches:
            yield pd.Series([_best_chain(w, _ends_in(tree, w), particles) for w in batch], index=batch.index, dtype=object)

    return words.select("token", walk("token").alias("chain"))


def _chains_by_join(words: DataFrame, vocabulary: DataFrame, particles: Sequence[str]) -> DataFrame:
    """Chains of each word by a join of its substrings with a vocabulary of any size."""
    longest = vocabulary.agg(F.max(F.length("piece"))).first()[0] or 1
    size = F.length("token")
    substrings = (
        words.withColumn("i", F.explode(F.sequence(F.lit(0), size - 1)))
        .withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.least(size, F.col("i") + longest))))
        .withColumn("piece", F.expr("substring(token, i + 1, j - i)"))
    )
    edges = substrings.join(vocabulary, "piece").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("edges"))

    @F.pandas_udf(_CHAIN)
    def walk(tokens: pd.Series, edge_lists: pd.Series) -> pd.Series:
        out = []
        for word, found in zip(tokens, edge_lists):
            ends: dict[int, list[int]] = {}
            for e in found:
                ends.setdefault(e["i"], []).append(e["j"])
            out.append(_best_chain(word, lambda i: ends.get(i, ()), particles))
        return pd.Series(out, index=tokens.index, dtype=object)

    return edges.select("token", walk("token", "edges").alias("chain"))


def compound_matches(texts: DataFrame, terms: DataFrame, particles: Sequence[str] = PARTICLES, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """Words made wholly of two or more spaceless terms, less one particle at most.

    Each distinct word is walked once along a prefix tree of the terms, keeping the shortest chain of pieces that ends at each
    place. Ties keep the whole word before the word without a particle, longer particles first. The terms are measured
    before they are sent as a tree; more than ``tree_bytes`` of them meet the substrings of the words in a join instead.
    """
    plain = terms.filter(~F.col("norm").rlike(tx.WHITESPACE)).select("source_id", "norm")
    vocabulary = plain.select(F.col("norm").alias("piece")).distinct()
    weight = vocabulary.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]

    def words(text: str):
        for found in _WORD.finditer(text):
            yield found.start(), found.group()

    tokens = _explode_texts(texts, words, _schema(texts, ("start", T.IntegerType()), ("token", T.StringType())))
    ordered = sorted(particles, key=len, reverse=True)
    chains_of = _chains_by_tree if weight <= tree_bytes else _chains_by_join
    best = chains_of(tokens.select("token").distinct(), vocabulary, ordered).filter("chain is not null")
    spans = tokens.join(best, "token").select("text_id", "start", "token", F.explode("chain").alias("c"))
    pieces_of = spans.select(
        "text_id", (F.col("start") + F.col("c.i")).alias("start"), (F.col("start") + F.col("c.j")).alias("end"),
        F.expr("substring(token, c.i + 1, c.j - c.i)").alias("norm"),
    )
    return pieces_of.join(plain, "norm").select("text_id", "source_id", "start", "end")


# --- dictionary records --------------------------------------------------------------------


def term_records(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names and aliases as one table of terms with what matching needs to know."""
    official = F.col("origin") == "official"
    bare = F.length(F.replace(F.col("ko"), F.lit(" "), F.lit("")))
    names = entries.select(
        F.col("ko").alias("term"), F.array("id").alias("target_ids"), F.col("id").alias("source_id"),
        F.when(official, "official_name").otherwise("concept_name").alias("source_type"),
        F.when(official, "official").otherwise("curated").alias("status"),
        F.when(F.col("category") == "champion_ability", F.concat(F.lit("champion:"), "champion_id")).alias("guard_owner"),
        F.when(F.col("category") == "champion_ability", F.concat(F.lit("slot:"), F.lower("slot"))).alias("guard_slot"),
        (F.col("ko").contains(" ") & (bare >= 4)).alias("compact"), F.lit(False).alias("all_items"),
    )
    categories = entries.select(F.col("id").alias("target"), "category")
    items = (
        aliases.select("id", F.explode("target_ids").alias("target")).join(categories, "target", "left")
        .groupBy("id").agg(F.bool_and(F.coalesce(F.col("category") == "item", F.lit(False))).alias("all_items"))
    )
    others = aliases.join(items, "id", "left").select(
        F.col("ko").alias("term"), "target_ids", F.col("id").alias("source_id"), F.col("type").alias("source_type"), "status",
        F.lit(False).alias("compact"), F.coalesce("all_items", F.lit(True)).alias("all_items"), "ambiguity", "historical",
    )
    return names.unionByName(others, allowMissingColumns=True)


def guard_cues(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Words that allow the ability names of an owner or of a slot."""
    owners = entries.filter("category = 'champion'").select(F.col("id").alias("cue"), F.col("ko").alias("term"))
    nick = aliases.select(F.explode("target_ids").alias("cue"), F.col("ko").alias("term")).filter(F.startswith("cue", F.lit("champion:")))
    slots = F.array(*[F.struct(F.lit(f"slot:{slot}").alias("cue"), F.lit(w).alias("term")) for slot, ws in SLOT_CUES.items() for w in ws])
    fixed = entries.sparkSession.range(1).select(F.inline(slots))
    return reduce(DataFrame.unionByName, [owners, nick, fixed]).distinct()


def context_guard(matches: DataFrame, hits: DataFrame) -> DataFrame:
    """Keep guarded matches only where a cue of their owner or slot occurs in the same text.

    ``matches`` has ``guard_owner`` and ``guard_slot`` (null: not guarded), ``hits`` (text_id, cue).
    """
    free = matches.filter("guard_owner is null and guard_slot is null")
    bound = matches.filter("guard_owner is not null or guard_slot is not null")
    # One row per text, so that matches are shuffled once for both guards.
    present = hits.groupBy("text_id").agg(F.collect_set("cue").alias("_cues"))
    met = F.array_contains("_cues", F.col("guard_owner")) | F.array_contains("_cues", F.col("guard_slot"))
    return free.unionByName(bound.join(present, "text_id").filter(met).drop("_cues").select(*matches.columns))


def negative_cue_filter(matches: DataFrame, texts: DataFrame, cues: DataFrame) -> DataFrame:
    """Drop matches of a source whose negative cue occurs anywhere in the text.

    ``cues`` has (source_id, cue). Only texts with a match of such a source are looked at, once for each different cue; matches
    meet the cues of their text in one join on the text.
    """
    folded = cues.select("source_id", tx.dictionary_key("cue", trimmed=False).alias("cue"))
    doubtful = matches.join(broadcast_if_small(folded.distinct()), "source_id").select("text_id", "cue").distinct()
    hit = doubtful.join(texts, "text_id").filter(F.contains(F.col("norm"), F.col("cue")))
    present = hit.groupBy("text_id").agg(F.collect_set("cue").alias("_present"))
    per_source = folded.groupBy("source_id").agg(F.collect_set("cue").alias("_cues"))
    rows = matches.join(broadcast_if_small(per_source), "source_id", "left").join(present, "text_id", "left")
    return rows.filter(~F.coalesce(F.arrays_overlap("_cues", "_present"), F.lit(False))).select(*matches.columns)


def without_exact(matches: DataFrame, exact: DataFrame) -> DataFrame:
    """Drop matches whose source is also matched exactly in the same text.

    Exact matches are many more; those that can bear on ``matches`` are picked first, so no task gathers the others.
    """
    keys = ["text_id", "source_id"]
    asked = cut_lineage(matches.select(*keys).distinct())
    return matches.join(exact.select(*keys).join(broadcast_if_small(asked), keys, "left_semi").distinct(), keys, "left_anti")


def role_terms(roles: Mapping[str, DataFrame]) -> DataFrame:
    """Several term tables (source_id, term) prepared as one, which is looked up in one pass over the texts."""
    tagged = [r.select(F.concat_ws("|", F.lit(role), "source_id").alias("source_id"), "term") for role, r in roles.items()]
    return prepared_terms(reduce(DataFrame.union, tagged))


def of_role(found: DataFrame, role: str) -> DataFrame:
    """What was found of one table of ``role_terms``."""
    own = found.filter(F.startswith("source_id", F.lit(f"{role}|")))
    return own.withColumn("source_id", F.expr(f"substring(source_id, {len(role) + 2})"))


def matches_by_role(texts: DataFrame, roles: Mapping[str, DataFrame]) -> Callable[[str], DataFrame]:
    """Look up several term tables (source_id, term) in one pass over the texts.

    The matches are written once; the returned function selects those of one role.
    """
    found = cut_lineage(bounded_matches(texts, role_terms(roles)))
    return lambda role: of_role(found, role)


def _numbered_records(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``term_records`` with a number, and how their target lists relate.

    ``single`` tells that no other list names the same targets; ``crowd`` is how many places of different terms a text may
    have for the list (a record each, and more only where ids are not unique).
    """
    sets = Window.partitionBy(F.array_sort(F.array_distinct("target_ids")))
    rows = term_records(entries, aliases).withColumns({
        "record": F.monotonically_increasing_id(),
        "single": F.size(F.collect_set("target_ids").over(sets)) == 1,
        "_same": F.count(F.lit(1)).over(Window.partitionBy("source_id")),
    })
    return cut_lineage(rows.withColumn("crowd", F.sum("_same").over(Window.partitionBy("target_ids"))).drop("_same"))


def dictionary_places(texts: DataFrame, records: DataFrame, cues: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """All matches of numbered records: text_id, record, match_type, size and ``starts``, exact ones of a term in a text as one row.

    Names, build-prefixed items and the guard ``cues`` (cue, term) are looked up in one pass over the texts. What a record
    says stays with the records, and steps that no record asks for are left out.
    """
    norm = normalized_texts(texts, id_col, text_col)
    kind = lambda df, name: df.withColumn("match_type", F.lit(name))
    one = lambda df: df.select("text_id", "source_id", (F.col("end") - F.col("start")).alias("size"), F.array("start").alias("starts"))
    keys = ["text_id", "source_id"]
    named = F.col("source_type").isin(*OFFICIAL)
    asks = {
        "items": F.col("all_items") & ~named, "compact": F.col("compact"), "others": ~named,
        "guards": F.col("guard_owner").isNotNull() | F.col("guard_slot").isNotNull(), "cues": F.size("ambiguity.negative_cues") > 0,
    }
    asked = records.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in asks.items()]).first()

    built_terms = records.filter(asks["items"]).withColumn("term", F.concat(F.lit(BUILD_PREFIX), tx.dictionary_key("term")))
    roles = {"exact": records, "built": built_terms} | ({"cue": cues.select(F.col("cue").alias("source_id"), "term")} if asked.guards else {})
    found = written(match_places(norm, role_terms(roles)))
    exact = of_role(found, "exact")
    parts = [kind(exact, "exact")]
    if asked.items:
        built = without_exact(of_role(found, "built"), exact)
        parts.append(kind(built.withColumns({"size": F.col("size") - 1, "starts": F.transform("starts", lambda s: s + 1)}), "item_build_prefix"))
    if asked.compact:
        loose = space_free_matches(norm, prepared_terms(records.filter("compact"))).join(exact.select(*keys), keys, "left_anti")
        parts.append(kind(one(loose), "space_omitted"))
    numbers = broadcast_if_small(records.select("source_id", "record", "guard_owner", "guard_slot", named.alias("named")))
    kept = reduce(DataFrame.unionByName, parts).join(numbers, "source_id")
    if asked.guards:
        kept = context_guard(kept, of_role(found, "cue").select("text_id", F.col("source_id").alias("cue")))
    if asked.cues:
        kept = negative_cue_filter(kept, norm, records.select("source_id", F.explode("ambiguity.negative_cues").alias("cue")))
    read = [found]
    if asked.others:
        kept = written(kept)
        read.append(kept)
        spans = ["text_id", "source_id", "start", "end"]
        known = kept.filter("not named").withColumn("start", F.explode("starts")).withColumn("end", F.col("start") + F.col("size"))
        made = compound_matches(norm, prepared_terms(records.filter(~named))).join(known.select(*spans), spans, "left_anti")
        kept = kept.unionByName(kind(one(made), "compound_segment").join(numbers, "source_id").select(*kept.columns))
    out = written(kept.select("text_id", "record", "match_type", "size", "starts"))
    discard(*read)
    return out


def dictionary_matches(texts: DataFrame, entries: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """All matches of a dictionary in the texts, one row each, with their type and the record they come from."""
    records = _numbered_records(entries, aliases)
    places = dictionary_places(texts, records, guard_cues(entries, aliases), id_col, text_col)
    start, end = F.explode("starts").alias("start"), (F.col("start") + F.col("size")).alias("end")
    rows = places.select("text_id", "record", "match_type", "size", start).select("text_id", "record", "match_type", "start", end)
    return rows.join(records.drop("single", "crowd"), "record").drop("record")


def match_order() -> list[Column]:
    """Start, longest first, official names first, source id."""
    return [F.col("start"), (F.col("start") - F.col("end")), F.col("source_type") != "official_name", F.col("source_id")]


# --- budgeted context ----------------------------------------------------------------------

# The limits and the wording of a context line, whose length counts.
MAX_ENTRIES, SHORT_ENTRIES, SHORT_TEXT, MAX_CHARACTERS = 8, 5, 80, 1800
PROMPT_HEADER = (
    "以下は原文に一致したLoL用語候補だけです。原文と文脈に合う意味だけを使い、"
    "根拠が足りない曖昧語を特定のLoL用語に決めつけないでください。"
    "候補一覧そのものを訳文へ出力しないでください。"
)
LINE_TEMPLATE = "[%s] 原文一致「%s」: %s.%s"
TARGET_TEMPLATE = "%s = %s（%s）"
CONDITION_TEMPLATE = " 文脈条件: %s 他の意味候補: %s."
HISTORY_TEMPLATE = " 旧称由来: %s。動画時期が不明なら現行名だったと断定しない。"
UNKNOWN_ORIGIN = "不明"


def distinct_targets(matches: DataFrame, limit: Column, order: Sequence[Column] | None = None, text: str = "text_id") -> DataFrame:
    """Matches in order, without those that repeat the target list of a kept one or lie inside a kept one of equal targets.

    Keeps at most ``limit`` rows per text and numbers them in ``rank``; matches without a target list are left out. Only
    matches of one set of targets bear on each other, so each such set of a text is walked by itself.
    """
    order = list(order or match_order())
    by = [text, "_set"]
    rows = matches.filter(F.col(text).isNotNull() & F.col("target_ids").isNotNull()).withColumn("_set", F.array_sort(F.array_distinct("target_ids")))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    # Whole rows are walked, so that what is kept need not be looked up again.
    step = F.struct("_i", F.struct(*matches.columns).alias("row"))
    walked = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(step), lambda a, b: a["_i"] - b["_i"]).alias("_all"), F.array_compact(F.array(F.first(F.when(F.lit(False), step)))).alias("_none")
    )

    def keep(kept: Column, m: Column) -> Column:
        row = m["row"]
        known = lambda k: (k["row"]["target_ids"] == row["target_ids"]) | ((row["start"] >= k["row"]["start"]) & (row["end"] <= k["row"]["end"]))
        return F.when(F.exists(kept, known), kept).otherwise(F.concat(kept, F.array(m)))

    rows = walked.select(text, F.explode(F.aggregate("_all", F.col("_none"), keep)).alias("_m"))
    rows = rows.select(text, *[F.col("_m.row")[c].alias(c) for c in matches.columns if c != text]).select(*matches.columns)
    place = Window.partitionBy(text).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def within_budget(rows: DataFrame, length: Column, budget: int, text: str = "text_id", rank: str = "rank") -> DataFrame:
    """Rows up to, and not including, the first whose length overflows the budget.

    Each row uses its length plus one; it stops there and does not try shorter rows later.
    """
    before = Window.partitionBy(text).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(text).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    used = rows.withColumn("_length", length).withColumn("_used", F.coalesce(F.sum(F.col("_length") + 1).over(before), F.lit(0)))
    over = used.withColumn("_over", F.max((F.col("_used") + F.col("_length") > budget).cast("int")).over(upto))
    return over.filter("_over = 0").drop("_length", "_used", "_over")


def record_wording(records: DataFrame, entries: DataFrame) -> DataFrame:
    """What a context line says of each numbered record: ``targets`` and ``note``. Records without a known target have none."""
    names = entries.select(
        F.col("id").alias("target"),
        F.format_string(TARGET_TEMPLATE, "ko", "ja", F.coalesce("meaning", "category")).alias("shown"),
    )
    targets = (
        records.select("record", F.posexplode("target_ids").alias("pos", "target")).join(broadcast_if_small(names), "target")
        .groupBy("record").agg(F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("_t"))
        .select("record", F.array_join(F.transform("_t", lambda t: t["shown"]), " / ").alias("targets"))
    )
    a, h = F.col("ambiguity"), F.col("historical")
    others = F.array_join(F.coalesce(a["other_meanings"], F.array().cast("array<string>")), "、")
    condition = F.when(a.isNotNull(), F.format_string(CONDITION_TEMPLATE, a["guidance"], others)).otherwise("")
    history = F.when(h.isNotNull(), F.format_string(HISTORY_TEMPLATE, F.coalesce(h["origin_ko"], F.lit(UNKNOWN_ORIGIN)))).otherwise("")
    return records.select("record", "status", a.isNotNull().alias("context_required"), F.concat(condition, history).alias("note")).join(targets, "record")


def first_places(places: DataFrame, records: DataFrame, limit: int) -> DataFrame:
    """Of the matches of ``dictionary_places`` those that can be among the first ``limit`` distinct ones of a text, one row each.

    Exact matches of a record whose targets no other list names count by the first place of its term, as later ones repeat its
    list; a list has at most ``crowd`` such places, so ``limit`` lists lie within ``limit`` times as many. Spark takes these
    from every input split before rows are shuffled. All other matches are given whole.
    """
    crowd, mixed = records.agg(F.max(F.when(F.col("single"), F.col("crowd"))), F.coalesce(F.bool_or(~F.col("single")), F.lit(False))).first()
    only_exact = records.filter(~F.col("source_type").isin(*OFFICIAL) | F.col("compact")).isEmpty()
    said = broadcast_if_small(records.select("record", "source_id", "source_type", "target_ids", "single"))
    columns = ["text_id", "record", "match_type", "source_id", "source_type", "target_ids", "start", "end"]

    # Only what the order needs is sorted: that of match_order, where the end follows from the size.
    ranked = broadcast_if_small(records.filter("single").select("record", "source_id", (F.col("source_type") != "official_name").alias("_later")))
    first = places.filter("match_type = 'exact'").select("text_id", "record", "size", F.array_min("starts").alias("start")).join(ranked, "record")
    order = Window.partitionBy("text_id").orderBy("start", -F.col("size"), "_later", "source_id")
    first = first.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit * (crowd or 1))
    first = first.select("text_id", "record", "size", "start", F.lit("exact").alias("match_type")).join(said, "record")
    end = F.col("start") + F.col("size")
    first = first.withColumn("end", end).select(*columns)
    if only_exact and not mixed:
        return first
    others = places.join(said, "record").filter(~F.col("single") | (F.col("match_type") != "exact")).withColumn("start", F.explode("starts"))
    return first.unionByName(others.withColumn("end", end).select(*columns))


def select_context(texts: DataFrame, entries: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text", max_entries: int = MAX_ENTRIES, max_characters: int = MAX_CHARACTERS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per text: the context block and the matches it was made of, after the columns ``keep`` of ``texts``.

    Matches are shuffled without texts and cut to what can be chosen; a text then meets its chosen matches once, and lines
    are worded and counted within its row.
    """
    records = _numbered_records(entries, aliases)
    places = dictionary_places(texts, records, guard_cues(entries, aliases), id_col, text_col)
    chosen = distinct_targets(first_places(places, records, max_entries), F.lit(max_entries)).join(broadcast_if_small(record_wording(records, entries)), "record")
    fields = ["rank", "target_ids", "source_id", "source_type", "status", "start", "end", "match_type", "context_required", "targets", "note"]
    per_text = chosen.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_chosen"))
    totals = places.groupBy("text_id").agg(F.sum(F.size("starts")).alias("_total"))
    raw = texts.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("_text"), *[c for c in keep if c != text_col])
    out = raw.join(per_text, "text_id", "left").join(totals, "text_id", "left")

    size = F.length("_text")
    limit = F.when(size <= SHORT_TEXT, F.least(F.lit(max_entries), F.lit(SHORT_ENTRIES))).otherwise(F.lit(max_entries))

    def worded(m: Column, matched: Column) -> Column:
        line = F.format_string(LINE_TEMPLATE, F.array_join(m["target_ids"], ","), matched, m["targets"], m["note"])
        given = lambda *names: [m[n].alias(n) for n in names]
        return F.struct(
            *given("rank", "target_ids", "source_id", "source_type", "status"), matched.alias("matched_text"),
            *given("start", "end", "match_type", "context_required"), line.alias("line"),
        )

    allowed = F.filter("_chosen", lambda m: m["rank"] <= limit)
    out = out.withColumn("_lines", F.transform(allowed, lambda m: worded(m, F.substring("_text", m["start"] + 1, m["end"] - m["start"]))))
    # As within_budget: a line uses its length plus one, and the first that overflows ends the block.
    used = lambda i: F.aggregate(F.slice("_lines", F.lit(1), i + 1), F.lit(-1), lambda n, m: n + F.length(m["line"]) + 1)
    out = out.withColumn("_kept", F.filter("_lines", lambda m, i: used(i) <= max_characters))
    count = F.greatest(F.lit(0), F.coalesce(F.size("_kept"), F.lit(0)))
    lines = F.array_join(F.transform("_kept", lambda m: m["line"]), "\n")
    return out.select(
        "text_id", *[F.col("_text" if c == text_col else c).alias(c) for c in keep], F.when(count > 0, F.concat(F.lit(PROMPT_HEADER + "\n"), lines)).otherwise("").alias("prompt_text"),
        F.sha2("_text", 256).alias("source_text_sha256"), count.alias("selected_count"), F.when(count > 0, F.col("_kept")).alias("matches"),
        (F.coalesce("_total", F.lit(0)) - count).alias("omitted_match_count"), limit.alias("entry_limit"),
    )


def glossary_hits(texts: DataFrame, glossary: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(text, entry) pairs of the older glossary: checked entries whose name or alias occurs."""
    checked = F.startswith("status", F.lit("source_checked")) | F.startswith("status", F.lit("community_source_checked"))
    listed = glossary.filter(checked).select(F.col("entry_id").alias("source_id"), F.explode(F.concat(F.array("ko"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"))
    found = bounded_matches(normalized_texts(texts, id_col, text_col), prepared_terms(listed), GLOSSARY_PARTICLES)
    return found.select("text_id", F.col("source_id").alias("entry_id")).distinct()


def glossary_text(hits: DataFrame, glossary: DataFrame) -> DataFrame:
    """The glossary block of each text, entries in glossary order (``position``)."""
    line = F.format_string("%s = %s (%s)", F.concat_ws(" / ", "ko", "aliases"), "ja", "meaning")
    lines = hits.join(glossary.select("entry_id", "position", line.alias("line")), "entry_id")
    pairs = F.array_sort(F.collect_list(F.struct("position", "line")))
    return lines.groupBy("text_id").agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("glossary"))
