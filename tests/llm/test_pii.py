from __future__ import annotations

import hashlib
import random
import re

from tessella.llm import pii

#: Valid by the check digit.
CARD = "4111 1111 1111 1111"
TEXTS = ["", "mail a.b@c.de, x@y, @z.com a@b.c@d.e f@g.h.i. é@a.b", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.4 1.2.3 9.9.9.9.", f"{CARD} 4111-1111-1111-1111 4111111111111112 1 2 3", "+1 (234) 555-1234 +12 +1.2.3.4.5.6.7.8.9 ++4412345678 (x)", "a@b.c-d_e.f %@-.-", "+1 (269) 555-3296 4111111111111111", "..@..a.b", "x@a.b@c.d", "@@a@b.cc", "日本 a@b.jp 日本+81 90 1234 5678、"]


def slow_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_are_the_definition():
    r = random.Random(6)
    for text in TEXTS + ["".join(r.choices("01234567890.-@+ ()ab_%é,", k=r.randint(1, 60))) for _ in range(4000)] + ["".join(r.choices("0 1.2-", k=60)) for _ in range(1000)]:
        assert pii.base_spans(text) == slow_spans(text), text


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "a@" * 50_000, "+1" + "(" * 100_000, "+1" * 50_000):
        pii.base_spans(text)


def planted():
    rows = [(i, f"please call extension now my badge number {1000000 + 17 * i}", "x") for i in range(3)]
    rows += [(10 + i, f"write to the backup hotline +1 234 555 {1000 + i} today", "x") for i in range(12)]
    rows += [(30, "the backup hotline 234 555 9999 is unseen", "x"), (31, "nothing 2345559999 before it, backup hotline soon", "x"), (32, None, None), (33, "", "x"), (34, TEXTS[1], "x"), (34, TEXTS[2], "x"), (34, TEXTS[2], "x"), (None, TEXTS[3], "x")]
    return rows


def test_find(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string, spans string").repartition(3)
    rows = pii.find(docs).collect()
    assert len(rows) == len(planted())
    got = {(r["doc_id"], r["spans"]): r for r in rows}
    for doc, text, _ in planted():
        base = slow_spans(text or "")
        joined = pii.joined(base)
        if doc == 30:  # discovered: it stands where known numbers do
            assert got[(30, "phone:19:31")]["n_learned"] == 1
            continue
        r = got[(doc, joined)]
        assert r["n_learned"] == 0 and r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for k, _, _ in base) for i in range(4)]


def test_unseen_shapes_by_contexts_on_both_sides(spark):
    """Keys that seed a context, shorter ones and numbers of other shapes found in it; checksums that have none stay."""
    r = random.Random(5)
    key = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows = [(i, f"set api token = \"{key(40)}\" for {''.join(r.choices('abcdefg', k=5))}") for i in range(20)]
    rows += [(100, 'then api token = "zz-91-Q" please'), (101, f"the sum {key(40)} is of {key(36)} files"), (102, 'again zz-91-Q alone, 1 a b')]
    rows += [(200 + i, f"dial +44 20 7946 {1000 + i} extension desk") for i in range(20)] + [(300, "so 7946/ab/12 extension desk"), (301, "a 12 desk")]
    got = {x["doc_id"]: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = dict(rows)
    said = {i: [(k, texts[i][int(s) : int(e)]) for k, s, e in (x.split(":") for x in got[i]["spans"].split(",") if x)] for i in got}
    assert all(("secret", texts[i][17:57]) in said[i] for i in range(20))  # one has a card's digits in it
    assert said[100] == [("secret", "zz-91-Q")] and said[101] == [] and said[102] == []
    assert said[300] == [("phone", "7946/ab/12")] and said[301] == []
    assert all([k for k, _ in said[200 + i]] == ["phone"] and got[200 + i]["n_learned"] == 0 for i in range(20))


def slow_discovered(occurrences, rounds=3, support=5, trust=0.8):
    """The graph by brute force: (row, kind, start, end) from rows of (row, kind, start, end, token, patterns)."""
    edges = {}
    for _, kind, _, _, token, patterns in occurrences:
        for p in patterns:
            edges.setdefault(p, {}).setdefault(token, []).append(0 <= kind < 4)
    seeds = {(t, k): 1.0 for _, k, _, _, t, _ in occurrences if k >= 0}
    known = dict(seeds)
    for _ in range(rounds):
        trusted = {}
        for p, tokens in edges.items():
            for kind in range(5):
                held = [known[t, kind] for t in tokens if (t, kind) in known]
                if len(held) >= support and sum(held) / (len(tokens) + 1) >= trust:
                    trusted[p, kind] = sum(held) / (len(tokens) + 1)
        doubt = {}
        for (p, kind), faith in trusted.items():
            for t, flags in edges[p].items():
                if not any(flags):
                    doubt[t, kind] = doubt.get((t, kind), 1.0) * (1 - faith)
        best = {}
        for (t, kind), d in doubt.items():
            if t not in best or (1 - d, -kind) > best[t]:
                best[t] = (1 - d, -kind)
        found = {t: -k for t, (score, k) in best.items() if score >= trust}
        known = dict(seeds)
        for t, kind in found.items():
            known[t, kind] = max(known.get((t, kind), 0), best[t][0])
    return {(row, found[t], s, e) for row, k, s, e, t, patterns in occurrences if not 0 <= k < 4 and t in found and (len(t) >= pii.TELLING or any((p, found[t]) in trusted for p in patterns))}


def test_the_graph_is_the_definition(spark):
    r = random.Random(11)
    words = ["call", "id", "key", "at", "the", "x"]
    tokens = ["+1 234 555 1%03d" % i for i in range(15)] + ["%040x" % r.getrandbits(160) for _ in range(15)] + [f"n{i}-{i}" for i in range(10)] + ["a@b.cc", "12"]
    by = {t: r.choice(words) for t in tokens}
    rows = [(i, " ".join(f"{by[t] if r.random() < 0.85 else r.choice(words)} {t} {r.choice(words)}" for t in r.choices(tokens, k=3))) for i in range(120)]
    seen = pii.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).cache()
    flat = [(x["row"], o["kind"], o["start"], o["end"], o["token"], o["patterns"]) for x in seen.collect() for o in x["occurrences"]]
    got = {tuple(x) for x in pii.discovered(seen, support=3, trust=0.5).collect()}
    want = slow_discovered(flat, support=3, trust=0.5)
    assert got == want and len(want) > 20


def test_redact(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string, _spans string").withColumnRenamed("_spans", "span_list").repartition(3)
    rows = pii.redact(docs, pii.find(docs))
    assert rows.columns == docs.columns
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(planted())
    assert (30, "the backup hotline [PHONE] is unseen", "x") in got and (32, None, None) in got
    assert (12, "write to the backup hotline [PHONE] today", "x") in got
    assert sum(r[1] == "[IP] 256.1.1.1 [IP].[IP] [IP] 1.2.3 [IP]." for r in got) == 2
    assert pii.masked("abcdef", "email:1:3,card:2:4") == "a[EMAIL]ef"


def test_nothing(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
