"""Terminology goldens on a small made-up dictionary, and brute force over random texts."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.operators import dictionary as dic, terms as tm

ENTRIES = [
    ("champion:Bora", "champion", "보라", "ボラ", None, None, "official", None),
    ("champion:Nuri", "champion", "누리", "ヌリ", None, None, "official", None),
    ("ability:Bora:Q", "champion_ability", "불꽃", "炎", "Bora", "Q", "official", None),
    ("ability:Nuri:R", "champion_ability", "거대한 파도", "大波", "Nuri", "R", "official", None),
    ("item:1", "item", "철의 방패막", "鉄の盾", None, None, "official", None),
    ("item:2", "item", "달빛검", "月光剣", None, None, "official", None),
    ("concept:gank", "gameplay", "갱킹", "ガンク", None, None, "curated_concept", "奇襲"),
]
ALIASES = [
    ("alias:shield", "방패", ["item:1"], "short", "source_checked", ["s"], "e", None, None),
    ("alias:moon", "달검", ["item:2"], "short", "source_checked", ["s"], "e", None, None),
    ("alias:bo", "보", ["champion:Bora"], "nick", "source_checked", ["s"], "e", ("一文字", ["歩"], ["보통"]), None),
    ("alias:nu", "누", ["champion:Nuri"], "nick", "source_checked", ["s"], "e", None, ("옛이름", None)),
    ("alias:both", "쌍검", ["item:2", "item:1"], "short", "source_checked", ["s"], "e", None, None),
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(ENTRIES, schemas.ENTRY), spark.createDataFrame(ALIASES, schemas.ALIAS)


def select(spark, dictionary, texts, **limits):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    out = tm.select_context(df, *dictionary, **limits)
    return {int(r.text_id): r for r in out.collect()}


def found(row):
    return [(m.source_id, m.match_type, m.start, m.end) for m in row.matches or []]


def test_selection_goldens(spark, dictionary):
    texts = [
        "보라가 갔다",            # name with a particle
        "나보라 갔다",            # inside a longer word
        "선달검 먼저",            # build prefix
        "철의방패막 샀다",        # blanks left out
        "불꽃 맞았다",            # ability without owner or slot
        "보라 불꽃 맞았다",       # owner in the text
        "q 불꽃",                 # slot in the text
        "궁극기 거대한파도를 썼다",   # slot cue and left-out blank
        "보 왔다", "보통 보 왔다",  # one character, negative cue
        "달검방패를 샀다",        # compound with a particle
        unicodedata.normalize("NFD", "보라 왔다"),
        "아무것도 없다",
        "누 왔다",
    ]
    got = {i: found(r) for i, r in select(spark, dictionary, texts).items()}
    assert got[0] == [("champion:Bora", "exact", 0, 2)]
    assert got[1] == [] and got[4] == [] and got[9] == [] and got[12] == []
    assert got[2] == [("alias:moon", "item_build_prefix", 1, 3)]
    assert got[3] == [("item:1", "space_omitted", 0, 5)]
    assert got[5] == [("champion:Bora", "exact", 0, 2), ("ability:Bora:Q", "exact", 3, 5)]
    assert got[6] == [("ability:Bora:Q", "exact", 2, 4)]
    assert got[7] == [("ability:Nuri:R", "space_omitted", 4, 9)]
    assert got[8] == [("alias:bo", "exact", 0, 1)]
    assert got[10] == [("alias:moon", "compound_segment", 0, 2), ("alias:shield", "compound_segment", 2, 4)]
    assert got[11] == [("champion:Bora", "exact", 0, 2)]
    assert got[13] == [("alias:nu", "exact", 0, 1)]


def test_prompt_lines_and_limits(spark, dictionary):
    texts = ["보 왔다", "누 왔다", "보라 보라 누리 방패 달검 쌍검 갱킹", "보라 " * 40 + "방패 달검"]
    rows = select(spark, dictionary, texts)
    assert rows[0].prompt_text.split("\n")[1] == "[champion:Bora] 原文一致「보」: 보라 = ボラ（champion）. 文脈条件: 一文字 他の意味候補: 歩."
    assert "旧称由来: 옛이름。" in rows[1].prompt_text
    assert rows[2].selected_count == 5 and rows[2].entry_limit == 5 and rows[2].omitted_match_count == 2
    assert "쌍검" in rows[2].prompt_text and "月光剣（item） / 철의 방패막" in rows[2].prompt_text
    assert rows[3].entry_limit == 8 and [m.source_id for m in rows[3].matches] == ["champion:Bora", "alias:shield", "alias:moon"]
    tight = select(spark, dictionary, texts[2:3], max_characters=80)[0]
    assert tight.selected_count < 5 and tight.selected_count + tight.omitted_match_count == 7
    assert select(spark, dictionary, ["없음"])[0].prompt_text == ""


def brute_bounded(text, needle, particles):
    edge = lambda i: i < 0 or i >= len(text) or not text[i].isalnum()
    out, at = [], text.find(needle)
    while at >= 0:
        end = at + len(needle)
        if edge(at - 1) and (edge(end) or any(text.startswith(p, end) and edge(end + len(p)) for p in particles)):
            out.append((at, end))
        at = text.find(needle, at + 1)
    return out


def test_bounded_equals_brute_force(spark):
    rng = random.Random(6)
    alphabet = "가나이은 .a_-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    terms = ["가", "가 나", "나.가", "a", "가이", "-a", "_", "나 은 가", "이은"]
    norm = tm.normalized_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text")
    listed = tm.prepared_terms(spark.createDataFrame([(t, t) for t in terms], "source_id string, term string"))
    got = sorted((r.text_id, r.source_id, r.start, r.end) for r in tm.bounded_matches(norm, listed).collect())
    assert got == sorted((i, t, *m) for i, text in enumerate(texts) for t in terms for m in brute_bounded(text, t, tm.PARTICLES))


def test_space_free_equals_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("가나다라  은.") for _ in range(40)) for _ in range(80)] + ["가나다라 가 나 다라은 x가나다라  가나 다 라"]
    terms = ["가나 다라", "나 다라가"]

    def brute(text, term):
        wanted, out = term.replace(" ", ""), []
        edge = lambda i: i < 0 or i >= len(text) or not text[i].isalnum()
        for start in range(len(text)):
            if not edge(start - 1):
                continue
            at, used = start, 0
            while at < len(text) and used < len(wanted):
                if text[at].isspace():
                    at += 1
                elif text[at] == wanted[used]:
                    at, used = at + 1, used + 1
                else:
                    break
            if used == len(wanted) and (edge(at) or any(text.startswith(p, at) and edge(at + len(p)) for p in tm.PARTICLES)):
                out.append((start, at))
        return out

    norm = tm.normalized_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text")
    listed = tm.prepared_terms(spark.createDataFrame([(t, t) for t in terms], "source_id string, term string"))
    got = sorted((r.text_id, r.source_id, r.start, r.end) for r in tm.space_free_matches(norm, listed).collect())
    want = sorted((i, t, *m) for i, text in enumerate(texts) for t in terms for m in brute(text, t))
    assert got == want and want


def test_compound_takes_the_fewest_pieces(spark):
    terms = ["가", "나", "가나", "다", "나다", "은다"]
    texts = ["가나다", "가나은", "가나다은", "가", "가나라", "가은다 나다가"]
    norm = tm.normalized_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text")
    listed = tm.prepared_terms(spark.createDataFrame([(t, t) for t in terms], "source_id string, term string"))
    got: dict[int, list] = {}
    for r in tm.compound_matches(norm, listed).collect():
        got.setdefault(r.text_id, []).append((r.start, r.source_id))
    got = {k: sorted(v) for k, v in got.items()}
    # Equal counts: the chain whose last piece starts first. A word that is one term is no compound.
    assert got == {0: [(0, "가"), (1, "나다")], 2: [(0, "가"), (1, "나다")], 5: [(0, "가"), (1, "은다"), (4, "나다"), (6, "가")]}


def test_glossary(spark):
    glossary = spark.createDataFrame(
        [(1, 0, "용", ["드래곤"], "竜", "x", "source_checked:a"), (2, 1, "바론", [], "バロン", "y", "unconfirmed"), (3, 2, "전령", None, "ヘラルド", "z", "community_source_checked")],
        "entry_id int, position int, ko string, aliases array<string>, ja string, meaning string, status string",
    )
    texts = spark.createDataFrame([("a", "드래곤을 먹고 전령"), ("b", "바론 용용")], "id string, text string")
    hits = tm.glossary_hits(texts, glossary)
    assert sorted(map(tuple, hits.collect())) == [("a", 1), ("a", 3)]
    assert tm.glossary_text(hits, glossary).first().glossary == "용 / 드래곤 = 竜 (x)\n전령 = ヘラルド (z)"


def test_collisions(spark, dictionary):
    entries, aliases = dictionary
    extra = aliases.unionByName(spark.createDataFrame([("alias:x", " 방패 ", ["item:2"], "short", "source_checked", ["s"], "e", None, None)], schemas.ALIAS))
    records = tm.term_records(entries, extra)
    got = {r.term: r.target_ids for r in dic.collision_report(records).collect()}
    assert got == {"방패": ["item:1", "item:2"], "쌍검": ["item:1", "item:2"]}
    assert {r.source_id for r in dic.collision_sources(records).filter(F.col("term") == "방패").collect()} == {"alias:shield", "alias:x"}


def test_phrases_by_positions_equal_brute_force(spark):
    """Random texts and phrases of words, signs and blanks; the brute force looks for each term at each place."""
    rng = random.Random(3)
    parts = ["a", "b", "ab", "가", "가는", "나", "-", ".", "  ", " ", "a는", " "]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(150)]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))).strip() for _ in range(120)} - {""})
    prepared = tm.prepared_terms(spark.createDataFrame([(w, w) for w in words], "source_id string, term string"))
    found = tm.bounded_matches(spark.createDataFrame(texts, "text_id long, norm string"), prepared)
    got = sorted(tuple(r) for r in found.select("text_id", "source_id", "start", "end").collect())
    tail = re.compile(rf"(?:{'|'.join(tm.PARTICLES)})?(?![^\W_])")
    want, listed = set(), prepared.collect()
    for i, text in texts:
        for r in listed:
            at = text.find(r.norm)
            while at >= 0:
                if (at == 0 or not text[at - 1].isalnum()) and tail.match(text, at + len(r.norm)):
                    want.add((i, r.source_id, at, at + len(r.norm)))
                at = text.find(r.norm, at + 1)
    assert got == sorted(want)


def brute_compound(word, vocabulary, particles):
    """Every body in turn: shortest chain, whole word first, then without the longest particle."""
    best = None
    for body in [word, *[word[: -len(p)] for p in sorted(particles, key=len, reverse=True) if word.endswith(p) and len(word) > len(p)]]:
        chains = {0: []}
        for i in range(len(body)):
            for j in range(i + 1, len(body) + 1):
                if i in chains and body[i:j] in vocabulary and (j not in chains or len(chains[i]) + 1 < len(chains[j])):
                    chains[j] = [*chains[i], (i, j)]
        chain = chains.get(len(body), [])
        if len(chain) >= 2 and (best is None or len(chain) < len(best)):
            best = chain
    return best or []


@pytest.mark.parametrize("tree_bytes", [0, 1 << 20])
def test_compound_equals_brute_force(spark, tree_bytes):
    """Random words, and in the tree form one of 10,000 letters without blanks."""
    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choice("가나다") for _ in range(rng.randint(1, 4))) for _ in range(14)} | {"가"})
    texts = ["".join(rng.choice("가나다은") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    if tree_bytes:
        texts.append("".join(rng.choice(vocabulary) for _ in range(4_000))[:10_000] + "가은")
    norm = tm.normalized_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text")
    listed = tm.prepared_terms(spark.createDataFrame([(t, t) for t in vocabulary], "source_id string, term string"))
    got: dict[int, list] = {}
    for r in tm.compound_matches(norm, listed, tree_bytes=tree_bytes).collect():
        got.setdefault(r.text_id, []).append((r.start, r.end))
    short = {i: brute_compound(t, set(vocabulary), tm.PARTICLES) for i, t in enumerate(texts[:60])}
    assert {i: sorted(g) for i, g in got.items() if i < 60} == {i: c for i, c in short.items() if c}
    if tree_bytes:
        chain = sorted(got[60])
        assert [a for a, _ in chain] == [0, *[b for _, b in chain[:-1]]] and len(chain) >= len(texts[60]) // 4


def test_only_wanted_tokens_and_pairs_leave_the_texts(spark):
    texts = spark.createDataFrame([(1, "보라가 _갔다. a. b, a b 보라는 x보라"), (2, None), (3, "a " * 3000)], "text_id int, norm string")
    every, pairs = tm.token_keys(texts), tm.token_pairs(texts)
    for kept in (frozenset(), frozenset(["보라", "a", ".", "a b", "a. "]), frozenset(["b 보라", "a a"])):
        some = tm.token_keys(texts, wanted=lambda: kept)
        assert sorted(some.collect()) == sorted(every.filter(F.col("key").isin(*kept)).collect())
        some = tm.token_pairs(texts, wanted=lambda: kept)
        assert sorted(some.collect()) == sorted(pairs.filter(F.col("pair").isin(*kept)).collect())
    assert ("보라" in {r.key for r in every.filter("text_id = 1").collect()}) and every.filter("text_id = 3").count() == 3000


def test_guards_and_cues_meet_matches_in_one_join_on_the_text(spark):
    rows = [(1, "s", "o", None), (1, "t", None, "p"), (2, "s", "o", "p"), (3, "s", None, None), (None, "s", None, None), (4, "u", "x", "p")]
    matches = spark.createDataFrame(rows, "text_id int, source_id string, guard_owner string, guard_slot string")
    hits = spark.createDataFrame([(1, "o"), (1, "o"), (2, "p"), (4, "o")], "text_id int, cue string")
    kept = tm.context_guard(matches, hits)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, matches.filter("source_id = 's'").collect()))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    texts = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, None), (4, "ef")], "text_id int, norm string")
    cues = spark.createDataFrame([("s", "A"), ("s", "d"), ("t", "zz"), ("s", None)], "source_id string, cue string")
    kept = tm.negative_cue_filter(matches, texts, cues)
    assert sorted(((r.text_id, r.source_id) for r in kept.collect()), key=repr) == sorted([(1, "t"), (3, "s"), (None, "s"), (4, "u")], key=repr)


def test_matches_without_exact_ones(spark):
    longer = spark.createDataFrame([(1, "a", 0), (1, "a", 5), (1, "b", 3), (2, "a", 1), (None, "a", 0)], "text_id int, source_id string, start int")
    exact = spark.createDataFrame([(1, "a"), (1, "a"), (3, "b"), (None, "a")], "text_id int, source_id string")
    assert sorted(tuple(r) for r in tm.without_exact(longer, exact).collect() if r.text_id) == [(1, "b", 3), (2, "a", 1)]
    plan = tm.without_exact(longer, exact)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan


def test_places_are_the_matches_of_a_term_in_one_row(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("가나이은 .a_-") for _ in range(rng.randrange(60)))) for i in range(60)] + [(60, None), (61, "a 가 나 " * 500)]
    norm = spark.createDataFrame(texts, "text_id int, norm string")
    listed = tm.prepared_terms(spark.createDataFrame([(t, t) for t in ("가", "가 나", "나.가", "a", "-a", "_", "이은")], "source_id string, term string"))
    places = tm.match_places(norm, listed)
    rows = places.select("text_id", "source_id", F.explode("starts").alias("start"), "size").collect()
    assert sorted((r[0], r[1], r[2], r[2] + r[3]) for r in rows) == sorted(tm.bounded_matches(norm, listed).collect())
    assert places.count() == places.select("text_id", "source_id").distinct().count()


def walked(rows, limit):
    """The rules of distinct_targets, one match after the other."""
    kept = []
    for m in sorted(rows, key=lambda m: (m.start, m.start - m.end, m.source_type != "official_name", m.source_id)):
        known = lambda k: set(k.target_ids) == set(m.target_ids) and (k.target_ids == m.target_ids or (k.start <= m.start and m.end <= k.end))
        if not any(map(known, kept)):
            kept.append(m)
    return [(m.source_id, m.match_type, m.start, m.end) for m in kept[:limit]]


def test_context_is_chosen_from_all_matches(spark, dictionary):
    """Lists that name the same targets in another order, several records of one list, and guards, cues and compounds."""
    entries, aliases = dictionary
    more = [("alias:sword", "검", ["item:1", "item:2"], "short", "s", ["s"], "e", None, None), ("alias:twice", "쌍검 검", ["item:2", "item:1"], "short", "s", ["s"], "e", None, None),
            ("alias:bora", "보라색", ["champion:Bora"], "nick", "s", ["s"], "e", None, None), ("alias:nowhere", "은검", None, "short", "s", ["s"], "e", None, None)]
    aliases = aliases.unionByName(spark.createDataFrame(more, schemas.ALIAS))
    rng = random.Random(9)
    parts = ["보라", "보라색", "누리", "불꽃", "거대한 파도", "거대한파도", "철의방패막", "달빛검", "방패", "달검", "보", "누", "보통", "쌍검", "쌍검 검", "검", "은검", "갱킹", "선", "은", "는", "q", " ", " ", " ", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([5, 20, 80]))) for _ in range(80)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    every: dict[int, list] = {}
    for r in tm.dictionary_matches(df, entries, aliases).collect():
        every.setdefault(r.text_id, []).append(r)
    got = tm.select_context(df, entries, aliases, max_entries=4, max_characters=10_000, keep=["text"]).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.text_id)] == texts
    for r in got:
        rows = every.get(r.text_id, [])
        assert found(r) == walked([m for m in rows if m.target_ids is not None], 4)
        assert r.selected_count + r.omitted_match_count == len(rows)
    assert sum(len(rows) for rows in every.values()) > 200
