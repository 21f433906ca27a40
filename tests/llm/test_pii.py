import hashlib
import random
import re

from llm_brute import base_spans

from tiltscale.llm import pii


def _listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def _check(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(_listed(want).encode()).hexdigest(), (r.doc_id, texts[r.doc_id][:200])
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(s[3] == kind for s in want)
        assert set(_listed(want).split(",")) <= set(r.spans.split(","))


def test_base_spans_of_documents(spark, documents, texts):
    rows = pii.report(documents).collect()
    assert len(rows) == len(texts)
    _check(rows, texts)


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(5)
    parts = [
        "a", "b.", "@", "1", "22", ".", "-", " ", "+", "(", ")", "é", "x@y.z", "1.2.3.4", "4465758382889437",
        "+1 (743) 555-3824", "\n", "💥", "%", "256.1.1.1", "0001.2.3.04", "a@b.c%d@e.f",
    ]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for i in range(600)}
    texts |= {9001: None, 9002: "", 9003: "a@b.c " * 500, 9004: "x" * 2000, 9005: "a@" + "b." * 2000, 9006: "1" * 3000}
    texts |= {9007: "1." * 2000, 9008: "+1" + " " * 3000, 9009: "1 " * 3000}
    rows = pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    _check(rows, texts)


def test_very_long_runs_cost_linear_time(spark):
    long = {1: "x" * 2_000_000, 2: "a@" + "b." * 500_000, 3: "1." * 500_000, 4: "5 " * 500_000, 5: "+1" + " " * 1_000_000}
    rows = pii.report(spark.createDataFrame(list(long.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_email for r in rows} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_running_sums_past_one_block(spark):
    df = spark.createDataFrame([([],), ([3],), (list(range(64)),), (list(range(65)),), (list(range(1000)),)], "x array<long>")
    for r in df.select("x", pii.running_sums("x").alias("s")).collect():
        assert r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))]


def test_contexts_lead_to_unseen_identifiers(spark):
    """Strings beside words that else stand beside phone numbers are found, elsewhere they are not."""
    rows = [(i, f"please dial +1 (743) 555-{1000 + i} tonight ok") for i in range(40)]
    rows += [(100, "please dial 743-555-9999 tonight ok"), (101, "page 743-555-9998 of the book"), (102, "nothing")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:12:24"
    assert got[101] == got[102] == ""
    assert got[0] == "phone:12:29"


def test_found_identifiers_lead_to_further_contexts(spark):
    """Strings beside "dial" are found by seeds, those beside "after" by what was found beside "dial"."""
    rows = [(i, f"please dial +1 (743) 555-{1000 + i} tonight") for i in range(20)]
    rows += [(100 + i, f"please dial 743-555-{2000 + i} after") for i in range(8)]
    rows += [(200 + i, f"number{i} 743-555-{3000 + i} after") for i in range(3)]
    rows += [(300, "page 743-555-9998 of the book")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "phone:12:24" for i in range(100, 108))
    assert all(got[i] == "phone:8:20" for i in range(200, 203))
    assert got[300] == ""


def test_a_context_half_unseen_is_trusted_and_a_mixed_one_is_not(spark):
    rows = [(i, f"please dial +1 (743) 555-{1000 + i} w{i}") for i in range(40)]
    rows += [(100 + i, f"please dial 743-555-{2000 + i} w{100 + i}") for i in range(40)]
    rows += [(200 + i, f"item +1 (743) 555-{4000 + i} w{200 + i}") for i in range(10)]
    # Dots make an address, which is no phone.
    rows += [(300 + i, f"item 210.11.12.{i} w{300 + i}") for i in range(10)] + [(400, "item 743-555-9998 w400")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "phone:12:24" for i in range(100, 140))
    assert got[400] == ""


def _spans_of(spark, lines):
    rows = list(enumerate(lines))
    return [r.spans for r in sorted(pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())]


def test_a_few_seeds_do_not_vouch_for_thousands(spark):
    """Order numbers beside a word that also stood before five phones stay, whatever their layout."""
    phones = [f"order +1 (743) 555-{1000 + i} a{i}" for i in range(5)]
    for numbers in ([f"{7000000 + 13 * i}" for i in range(3000)], [f"743-555-{4000 + i}" for i in range(3000)]):
        got = _spans_of(spark, phones + [f"order {n} b{i}" for i, n in enumerate(numbers)])
        assert got[:5] == ["phone:6:23"] * 5 and not any(got[5:])


def test_only_layouts_of_the_seeds_are_found(spark):
    seeds = [f"order +1 (743) 555-{1000 + i} a{i}" for i in range(30)] + [f"wire +17435551{100 + i} a{i}" for i in range(30)]
    more = ["order 743-555-9999 c", "order 7435559997 c", "order 12345678 c", "wire 7435559999 c", "wire 743-555-9998 c", "wire 1234567 c"]
    assert _spans_of(spark, seeds + more)[60:] == ["phone:6:18", "", "", "phone:5:15", "", ""]


def _plain_bootstrap(pairs, rounds=pii.ROUNDS):
    """The bootstrap over ``(word, value, kind of a seed or None, kinds it fits, layouts by kind)``, in sets."""
    found = {}
    for _ in range(rounds):
        doubt = {}
        for word in {p[0] for p in pairs}:
            own = [p for p in pairs if p[0] == word]
            for kind in pii.KINDS:
                fits = [p for p in own if (p[2] == kind if p[2] else kind in p[3])]
                for layout in {x for p in fits for x in p[4][kind]}:
                    alike = [p for p in fits if layout in p[4][kind]]
                    seeds = sum(p[2] is not None for p in alike)
                    gained = [found[p[1], kind] for p in alike if p[2] is None and (p[1], kind) in found]
                    known = seeds + len(gained)
                    if known < 5 or 3 * known < len(alike):
                        continue
                    trust = min(0.999, (seeds + sum(gained)) / (known + len(own) - len(fits)))
                    if trust >= 0.8:
                        for p in alike:
                            if p[2] is None:
                                doubt[p[1], kind] = doubt.get((p[1], kind), 1.0) * (1 - trust)
        found = {key: 1 - d for key, d in doubt.items() if 1 - d >= 0.9}
    best = {}
    for (value, kind), score in found.items():
        best[value] = max(best.get(value, (0, "")), (round(score, 9), kind))
    return best


def test_bootstrap_equals_a_plain_one(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    occurrences = []
    for i in range(900):
        tail = f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        value = rng.choice([f"+1 (743) {tail}", f"+1 (743) {tail}", f"743-{tail}", f"7{i:06d}", f"a{i}@b.org", f"a{i}@host", f"10.0.{i % 250}.{i % 7}", f"999.0.0.{i}"])
        at = rng.randrange(11)
        # Words lean to one form, so that some are trusted and some are mixed.
        if rng.random() < 0.9:
            value = [f"+1 (743) {tail}", f"743-{tail}", f"a{i}@b.org", f"a{i}@host"][at % 2 * 2 + (rng.random() < 0.4)]
        occurrences.append((value, words[at], words[at + rng.randrange(2)]))
    df = spark.createDataFrame(occurrences, "value string, left string, right string")
    got = {r.value: (round(r.score, 9), r.kind) for r in pii.bootstrap(df).collect()}
    kinds = list(pii.KINDS)
    pairs = set()
    for value, left, right in occurrences:
        spans = base_spans(value)
        seed = min((s[1], s[3]) for s in spans)[1] if spans else None
        digits = re.sub("[^0-9]", "", value)
        shapes = []
        if re.fullmatch(r"[^\s@]+@[^\s@]*[a-z][^\s@]*", value):
            shapes.append("email")
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value) and 4 <= len(digits) <= 12:
            shapes.append("ip")
        if re.fullmatch(r"[0-9][0-9 -]+", value) and 12 <= len(digits) <= 19:
            shapes.append("card")
        if re.fullmatch(r"[0-9][0-9 ().-]+", value) and 7 <= len(digits) <= 15:
            shapes.append("phone")
        groups = " ".join("d" * len(g) for g in re.findall("[0-9]+", value))
        tails = [groups]
        for _ in range(3 if seed == "phone" else 0):
            tails.append(tails[-1][1:].strip())
        layouts = {k: ("",) if k in ("email", "ip") else tuple(tails if k == "phone" else [groups]) for k in kinds}
        for side, word in (("left", left), ("right", right)):
            pairs.add((f"{side} {word}", value, seed, tuple(shapes), tuple(layouts.items())))
    plain = _plain_bootstrap([(*p[:4], dict(p[4])) for p in pairs])
    assert got == plain
    assert len(plain) > 50 and {k for _, k in plain.values()} >= {"phone", "email"}


def test_scattered_contexts_lead_nowhere(spark, documents, texts):
    added = [r for r in pii.report(documents).collect() if r.spans != _listed(base_spans(texts[r.doc_id]))]
    assert len(added) <= 0.01 * len(texts)


def test_redacted_rows(spark, documents, texts):
    rows = pii.redact(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        if not spans:
            assert r.text == texts[r.doc_id]
        else:
            assert not base_spans(r.text)
            assert r.text.count("[") >= 1


def test_odd_rows(spark, odd_documents, no_documents):
    rows = pii.report(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    kept = pii.redact(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd_documents.collect()))
    assert pii.report(no_documents).count() == 0


def test_only_native_operators(spark, documents):
    plan = pii._matches(documents, "text")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
