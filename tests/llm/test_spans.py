"""Secrets and personal data against the plain rules."""

from __future__ import annotations

import base64
import json
import random
import re

import cases
import pytest

from cueweave.llm import private_data, secrets

ALPHABET = list("aZ0159.@+- ()_é\n𝄞%=\"'") + ["@a.b", "1.2.3.4", "+1 (", "token=", "Secret: ", "AKIA", "api_key", "0f" * 20, "passwd"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(90))) for _ in range(n)]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 13 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def secret(text):
    rules = {
        "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    }
    found = [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text, re.A) if ok(m)]
    return sorted(found, key=lambda s: (s[1], list(rules).index(s[0])))


FIXED = [None, "", "a@b.c_d@e.f", "0001.02.003.255 1.2.3.256 1.2.3.4.5", "4758 5284 7990 0355 12", "1 " * 3000, "a" * 20000, "1.2.3.4 " * 500]


def test_personal_base_spans(spark):
    rows = [(i, t) for i, t in enumerate([*texts(1, 1500), *FIXED])]
    docs = cases.documents(spark, rows)
    got = {r.doc_id: [tuple(s) for s in r.base] for r in private_data.personal_data(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == personal(t or ""), t


def test_personal_added_spans(spark):
    rng = random.Random(3)

    def phone():
        return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    rows = [(i, f"call me at {phone()} or not") for i in range(600)] + [(1000 + i, f"order {rng.randrange(10**6, 10**9)} came") for i in range(600)]
    rows += [(5000, f"see {phone()} 452413226 x"), (5000, f"see {phone()} 452413226 x"), (5001, "nothing here")]
    out = private_data.personal_data(cases.clashing(spark, rows))
    got = out.collect()
    assert len(got) == len(rows)
    hidden = [r for r in got if r.doc_id == 5000]
    assert all(not r.base and any(s.start == 4 and s.end == 21 for s in r.added) for r in hidden)
    assert not any(r.added for r in got if r.doc_id >= 1000 and r.doc_id != 5000)
    assert all((r.base[0].start, r.base[0].end) == (11, 28) and not r.added for r in got if r.doc_id < 1000)


def test_personal_thresholds_cover_all_candidates(spark):
    rng = random.Random(6)
    rows = [(i, f"call me at +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} or not") for i in range(1500)]
    rows += [(2000 + i, f"order {rng.randrange(10**6, 10**9)} came") for i in range(1500)]
    rows += [(4000 + i, f"at 10.0.{rng.randrange(255)}.{rng.randrange(255)} now") for i in range(8)]
    rows += [(5000, "at 10.0.0.1 now")] * 500
    text = private_data.text_of()
    base = private_data.F.concat(*[private_data.base_spans(text, k) for k in private_data.BASE])
    every = private_data.F.concat(*[private_data.candidates(text, g) for g in private_data.GENERATORS])
    found = cases.documents(spark, rows).select(base.alias("base"), every.alias("candidates"))
    for sample in (50, 20_000):  # a bound far below and far above the number of candidates
        assert set(private_data.train(found, sample).thresholds) >= {"phone_like", "ip_like"}


def test_personal_chains_of_overlaps_are_taken_to_their_end(spark):
    rng = random.Random(8)
    rows = [[("k", 10 * i, 10 * i + 12, i / 50) for i in range(40)], [("k", 10 * i, 10 * i + 12, 0.9) for i in range(40)], []]
    for _ in range(60):
        starts = rng.sample(range(60), rng.randrange(1, 40))
        rows.append([("k", s, s + rng.randrange(1, 15), rng.randrange(5) / 5) for s in starts])

    def best(spans):
        out = []
        for c in sorted(spans, key=lambda c: (c[3], c[2] - c[1], -c[1]), reverse=True):
            if not any(o[1] < c[2] and c[1] < o[2] for o in out):
                out.append(c)
        return sorted(out)

    df = spark.createDataFrame(list(enumerate(rows)), "i int, spans array<struct<kind:string,start:int,end:int,score:double>>")
    got = {r.i: [tuple(s) for s in r.c] for r in df.select("i", private_data.F.array_sort(private_data.chosen(private_data.F.col("spans"))).alias("c")).collect()}
    assert len(got[0]) == 20 and len(got[1]) == 20
    assert all(got[i] == best(spans) for i, spans in enumerate(rows))


def test_personal_awkward_and_empty(spark):
    assert private_data.personal_data(cases.awkward(spark)).count() == cases.awkward(spark).count()
    assert private_data.personal_data(cases.nothing(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_secret_spans(seed):
    keywords = secrets.automaton()
    for t in [*texts(seed, 3000), "İtoken:12345678 SECRET=token=password1 APIKEY:'12345678", "İ" * 5 + "\u212apassword=12345678", "token=password=12345678 secretsecret=12345678"]:
        base = [s for s in secrets.secret_spans(t, keywords) if s[0] in secrets.BASE]
        assert base == secret(t), t


def test_checked_kinds():
    keywords = secrets.automaton()
    body = "azq" * 10  # no run of hexadecimal digits
    good, bad = "ghp_" + body + secrets.base62_crc(body), "ghp_" + body + "000000"
    assert ("checked", 2, 42) in secrets.secret_spans("x " + good, keywords) and not secrets.secret_spans(bad, keywords)
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    assert [s[0] for s in secrets.secret_spans(f"{head}.eyJhIjoxfQ.abc", keywords)] == ["jwt"]
    assert not secrets.secret_spans("eyJub3BlIjoxfQ.eyJhIjoxfQ.abc", keywords)
    der = base64.b64encode(b"\x30\x03abc").decode()
    assert [s[0] for s in secrets.secret_spans(f"-----BEGIN PRIVATE KEY-----\n{der}\n-----END PRIVATE KEY-----", keywords)] == ["key"]


def test_secret_scan_rows(spark):
    docs = cases.awkward(spark)
    assert secrets.scan_secrets(docs).count() == docs.count() and secrets.scan_secrets(cases.nothing(spark)).count() == 0
    rows = secrets.scan_secrets(cases.clashing(spark, [(1, "password=abcdefgh1"), (1, "password=abcdefgh1"), (2, None)])).collect()
    assert [[tuple(s) for s in r.spans] for r in sorted(rows, key=lambda r: r.doc_id)] == [[("assign", 0, 18)]] * 2 + [[]]
