import math
import hashlib
import random
import re
import time

from conftest_pii import base_spans

from kmerloom.llm import pii


def test_base_equals_brute_force(odd):
    got = {r.doc_id: r for r in pii.find_pii(odd).collect()}
    for r in odd.select("doc_id", "text").collect():
        want = base_spans(r.text or "")
        assert [(pii.KINDS[x.kind], x.s, x.e) for x in got[r.doc_id].base] == want
    assert len(got[10].base) == 4


def test_hard_texts(spark):
    texts = [
        "a@b.c_x@y.z.w..q@r.s",
        "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.00000000000000000000000000000000000000000000004",
        "4111-1111 1111-1111 - 4 4111111111111112 " + "1" * 40,
        "+1 (437) 555-0689 +49 30 1234567890123456 +12 +1.2.3.4.5.6.7.8.9",
        "😀é@x.y  mail@ex-ample.co.uk😀",
        "z" * 50_000 + "@" + "y" * 50_000,
        "1 " * 5000,
        "ab@" * 2000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.find_pii(docs).collect():
        assert [(pii.KINDS[x.kind], x.s, x.e) for x in r.base] == base_spans(texts[r.doc_id]), r.doc_id


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"please write to the address call me: +1 (437) 555-06{k:02d} thanks" for k in range(20)]
    unseen = ["kindly call me: 0437/555-0699x today", "just 0437/555-0699x alone", "no number call me soon"]
    others = [f"page {k} of chapter {k * 7} has {k + 3} lines" for k in range(40)]  # most tokens of a corpus are no identifiers
    docs = spark.createDataFrame(list(enumerate(seeds + unseen + others)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    found = got[20]
    assert [(pii.KINDS[x.kind], unseen[0][x.s : x.e]) for x in found.spans] == [("phone", "0437/555-0699x")]
    assert found.base == [] and got[21].spans == [] and got[22].spans == []
    assert all(len(got[k].base) == 1 and got[k].spans == got[k].base for k in range(20))


def test_query_digests(spark, odd, tmp_path):
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op2_pii(spark, str(tmp_path)).where("doc_id = 10").collect():
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(odd.where("doc_id = 10").first().text))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans == listed and (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
        assert re.fullmatch(r"(\w+:\d+:\d+,?)+", r.spans)


def test_empty(empty):
    assert pii.find_pii(empty).count() == 0


def plain_contexts(text, s, e):
    """The four lexical patterns of an occurrence, from the words around it."""
    mask = lambda words: re.sub("[0-9]+", "#", " ".join(words).lower())
    before, after = text[:s].split(), text[e:].split()
    out = [("<<", before[-2:], 2), ("<", before[-1:], 1), (">", after[:1], 1), (">>", after[:2], 2)]
    return [f"{mark} {mask(words)}" for mark, words, n in out if len(words) == n]


def plain_discovery(texts, rounds=3, least=0.8, prior=0.5, alpha=0.01):
    """Spans (text number, kind, s, e) that the bootstrap adds, by plain loops over the whole graph."""
    seeds, free = [], []
    for k, t in enumerate(texts):
        base = base_spans(t)
        seeds += [(plain_contexts(t, s, e), t[s:e], pii.KINDS.index(kind)) for kind, s, e in base]
        for m in re.finditer(r"(?<!\S)(?=\S*[0-9@_])\S+", t):
            lead = len(re.match(r"[\W_]*", m[0])[0])
            core = re.sub(r"[\W_]+$", "", m[0][lead:])
            s, e = m.start() + lead, m.start() + lead + len(core)
            if core and not any(a < e and s < b for _, a, b in base):
                secret = len(pii.KINDS) if re.fullmatch("[0-9a-f]{32,64}", core) and re.search("[a-f]", core) and re.search("[0-9]", core) else None
                free.append((plain_contexts(t, *m.span()), core, secret, k, s, e))
    edges = {}
    for contexts, m, seed in seeds + [f[:3] for f in free]:
        for c in contexts:
            have = edges.setdefault(c, {})
            have[m] = seed if have.get(m) is None else have[m] if seed is None else min(have[m], seed)
    edges = {c: xs for c, xs in edges.items() if len(xs) >= 2}
    kinds = range(len(pii.ADDED))
    fixed = {}
    for xs in edges.values():
        for m, seed in xs.items():
            if seed is not None:
                fixed[m] = min(seed, fixed.get(m, seed))
    score = {m: [float(fixed.get(m) == k) for k in kinds] for xs in edges.values() for m in xs}
    pairs = sum(map(len, edges.values()))
    rates = [(sum(seed == k for xs in edges.values() for seed in xs.values()) + 0.5) / (pairs + 1) for k in kinds]

    def sure(hits, n, rate):
        """By the binomial tail's bound, with the pattern count as the number of trials."""
        p = hits / n
        if p <= rate:
            return False
        return len(edges) * math.exp(-(hits * math.log(p / rate) + ((n - hits) * math.log((1 - p) / (1 - rate)) if hits < n else 0))) <= alpha

    for turn in range(rounds):
        sums = {c: [sum(score[m][k] for m in xs) for k in kinds] for c, xs in edges.items()}
        trust = {c: [h / (len(edges[c]) + prior) if sure(h, len(edges[c]), rates[k]) else 0.0 for k, h in enumerate(hs)] for c, hs in sums.items()}
        if turn + 1 < rounds:
            score = {m: v if m in fixed else [max((trust[c][k] for c in trust if m in edges[c]), default=0.0) for k in kinds] for m, v in score.items()}
    trusted = {c: (-max(v), v.index(max(v))) for c, v in trust.items() if max(v) >= least}
    out = set()
    for contexts, _, _, k, s, e in free:
        best = min((trusted[c] for c in contexts if c in trusted), default=None)
        if best:
            out.add((k, pii.ADDED[best[1]], s, e))
    return out


def test_discovery_equals_the_plain_form(spark):
    r = random.Random(6)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f"alpha {r.choice(['x', 'y'])} token = \"{hexes(40)}\" omega {k}" for k in range(12)]
    texts += [f'again TOKEN = "{hexes(40).upper()}" end', "no = token 7", 'see token = "A_1-b" here']
    texts += [f"call me at +1 (437) 555-06{k:02d} today please" for k in range(20)] + ["call me at 0437/555x today please", "call at 5 today", "(id_7) me at 17 today"]
    texts += [f"mail to bob{k}@example.com from {k}.1.2.3 ok" for k in range(20)] + ["mail to bob@localhost from here ok", "1 2 3 4 5 6 7", "", "a " * 300 + "7 " + "b" * 300 + " 8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = plain_discovery(texts)
    got, base = set(), {}
    for x in pii.find_pii(docs).collect():
        base[x.doc_id] = {(y.kind, y.s, y.e) for y in x.base}
        got |= {(x.doc_id, pii.ADDED[y.kind], y.s, y.e) for y in x.spans if (y.kind, y.s, y.e) not in base[x.doc_id]}
    assert got == want
    found = {(k, texts[k][s:e]) for k, _, s, e in got}
    assert {texts[12].split('"')[1], "A_1-b", "0437/555x", "bob@localhost"} <= {m for _, m in found}


def test_chance_patterns_are_not_trusted(spark):
    """Three instances that happen to be of one kind prove nothing; what needs no expression to be found is found."""
    texts = [f"und {k}: write {w} bob{k}@example.com now" for k, w in enumerate(["zum", "zum", "zum", *[f"w{j}" for j in range(60)]])] + ["zum a7 he said", "word 5 b6"]
    texts += [f"login with user-id U{k}/{k * 7919 % 1000} ok" for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    added = [(x.doc_id, y.s) for x in pii.find_pii(docs).collect() for y in x.spans if tuple(y) not in {tuple(b) for b in x.base}]
    assert added == [] and plain_discovery(texts) == set()


def test_many_matches_in_one_text(spark):
    """200,000 numbers in a text end in seconds, with the right places."""
    text = "1 " * 200_000 + "x@y.zz " * 3
    began = time.time()
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [(x.kind, x.s, x.e) for x in row.base] == [(0, 400_000 + 7 * k, 400_006 + 7 * k) for k in range(3)]
    assert time.time() - began < 90
