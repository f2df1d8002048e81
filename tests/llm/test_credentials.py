import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from roadweave.llm import credentials
from roadweave.llm.queries import queries

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def by_hand(text):
    """Spans of the patterns, as the contract writes them: every match, failing ones dropped."""
    out = [(m.start(2), 0, "assign", m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def line(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def likelihood(formats, token):
    """The score with plain dictionaries, a character at a time."""
    best = -math.inf
    for a in formats.automata.values():
        state, p = 0, 1.0
        for c in token:
            log, state = a.step[state][c]
            p *= math.exp(log)
        best = max(best, p * math.exp(a.end[state]))
    plain = 1.0
    for a, b in zip("^" + token, token + "^"):
        plain *= math.exp(formats.plain[a][b])
    return math.log(best / plain) if best > 0 else -math.inf


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    formats = credentials.train(docs)
    assert set(formats.automata) >= {"assign", "hex"}
    got = {r.doc_id: r for r in queries()["op12_automata_secrets"](spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        base = by_hand(text)
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
            if len(m[0]) >= 12 and not any(s < m.end() and m.start() < e for s, _, _, e in base) and likelihood(formats, m[0]) >= credentials.LEAST:
                more.append((m.start(), m.end()))
        r = got[doc]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        every = [s.split(":") for s in r.spans.split(",") if s]
        assert sorted(map(int, (s[1] for s in every))) == [int(s[1]) for s in every] and len(every) == len(base) + len(more) and r.n_added == len(more)
        assert {(int(s), int(e)) for k, s, e in every if k.startswith("like_")} == set(more) and {":".join(s) for s in every if not s[0].startswith("like_")} == set(filter(None, line(base).split(",")))
    assert sum(r.n_added for r in got.values()) <= 0.01 * len(got)  # plain words are left alone


def test_patterns_on_odd_texts():
    rng = random.Random(1)
    parts = ["token", "Secret", "API_KEY", "apikey", "passwd", "PASSWORD", '"', "'", " ", "=", ":", "  ", "abcdef0123456789", "0123456789abcdef01", "AKIA", "AKIA1234567890ABCD", "x", "é", "\n", "ſecret", "-", "ZZZZZZZZZZZZ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [(s, k, e) for s, k, _, e in by_hand(text)] == credentials.pattern_spans(text), text


def test_states_are_merged():
    rng = random.Random(2)
    pairs = credentials.infer(["ab" * (1 + int(rng.expovariate(0.7))) for _ in range(2000)])
    assert 2 <= len(pairs.step) <= 4  # after an a, after a b, the start
    odd = pairs.step[0]["a"][1]
    assert pairs.step[odd]["b"][0] > -0.1 > -5 > pairs.step[odd]["a"][0]
    keys = credentials.infer(["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(500)])
    assert 5 <= len(keys.step) < 60  # the prefix is kept, what is random is merged
    other = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    assert keys.score(other) > keys.score(other[::-1]) + 10 and keys.score(other) > keys.score(other.lower()) + 30
    for a in (pairs, keys):
        for step, end in zip(a.step, a.end):
            assert abs(sum(math.exp(p) for p, _ in step.values()) + math.exp(end) - 1) < 1e-9
    assert credentials.infer([]) is None and len(credentials.infer(["", ""]).step) == 1


def test_formats_are_found_without_their_pattern(spark, text_of):
    """Values of another length or without their key are found by format, words are not."""
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "vault-" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(20))
    rows = [(i, f"{text_of(60)}\ntoken = \"{name()}\" {text_of(20)} {key(40)} internationalisation") for i in range(300)]
    alone = [(i, f"{text_of(30)} {name()} {text_of(30)} {key(15)} uncharacteristically {text_of(30)}") for i in range(1000, 1050)]
    docs = spark.createDataFrame(rows + alone, "doc_id long, text string")
    formats = credentials.train(docs.where("doc_id < 1000"))
    got = {r.doc_id: r for r in credentials.find(docs, formats).collect()}
    for i, text in alone:
        words = {text[s.start : s.end]: s.kind for s in got[i].added}
        assert any(w.startswith("vault-") for w in words) and "uncharacteristically" not in words and not got[i].base
    assert sum(any(len(text[s.start : s.end]) == 15 for s in got[i].added) for i, text in alone) >= 45
    assert all(len(got[i].base) == 2 and not got[i].added and min(s.score for s in got[i].base) > 0 for i, _ in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    formats = credentials.train(odd_docs)
    assert formats.automata == {}
    names = odd_docs.withColumns({"base": F.lit("b"), "added": F.lit(1), "kind": F.lit("k"), "spans": F.lit(2), "n": F.lit(3)})
    got = credentials.digests(credentials.find(names, formats)).collect()
    assert len(got) == odd_docs.count() and {r.spans for r in got} == {""} and sum(r.doc_id == 1 for r in got) == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in got} == {empty}
    assert credentials.train(no_docs).automata == {} and credentials.find(no_docs, formats).count() == 0
    long = "0123456789abcdef" * 50_000
    one = spark.createDataFrame([("a", f"x {long} y"), ("b", "é token=" + long)], "doc_id string, text string")
    got = {r.doc_id: r for r in credentials.digests(credentials.find(one, formats)).collect()}
    assert got["a"].spans == "hex:2:800002" and got["b"].spans == "assign:8:800008,hex:8:800008"


def test_every_document_is_learned_from(spark):
    """The counts are those of all credentials and all plain tokens, however many there are, and each distinct credential counts once."""
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(16 + i % 9)) for i in range(3000)]
    docs = spark.createDataFrame([(i, f"{hexes[i % 3000]} uncharacteristic{i % 7}x") for i in range(21_000)], "doc_id long, text string")
    formats = credentials.train(docs)
    a = formats.automata["hex"]
    # All 3000 begin at the start; its frequencies are whole counts, as is the chain's.
    states = [{c: to for c, (_, to) in step.items()} for step in a.step]
    passed, ended = [dict.fromkeys(credentials.ALPHABET, 0) for _ in states], [0] * len(states)
    for value in hexes:
        state = 0
        for c in value:
            passed[state][c] += 1
            state = states[state][c]
        ended[state] += 1
    for i, step in enumerate(a.step):
        total = sum(passed[i].values()) + ended[i] + credentials.SMOOTH * (len(credentials.ALPHABET) + 1)
        assert math.isclose(a.end[i], math.log((ended[i] + credentials.SMOOTH) / total))
        assert all(math.isclose(step[c][0], math.log((n + credentials.SMOOTH) / total)) for c, n in passed[i].items())
    assert sum(ended) == 3000
    assert math.isclose(formats.plain["^"]["u"], math.log(21_001 / (21_000 + len(credentials.ALPHABET) + 1)))


def test_rare_beginnings_are_no_states():
    rows = [("a", 8, 0), ("b", 2, 2), ("aa", 6, 6), ("ab", 1, 1), ("ac", 1, 0)]
    tree = credentials._Tree.of_counts(10, rows, 2)
    assert tree.through == [10, 8, 2, 6] and tree.edges[1] == {"a": [3, 6], "b": [None, 1], "c": [None, 1]}
    states = credentials.merged(tree)
    assert sum(ends for _, ends in states) >= 8 and all(0 <= to < len(states) for edges, _ in states for to, _ in edges.values())


def plainly_compatible(tree, a, b, alpha):
    """The test of two states by its definition, nothing remembered."""
    m, n = tree.through[a], tree.through[b]
    most = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(m) + 1 / math.sqrt(n))
    left, right = tree.edges[a], tree.edges[b]
    if abs(tree.ends[a] / m - tree.ends[b] / n) > most or any(abs((left[c][1] if c in left else 0) / m - (right[c][1] if c in right else 0) / n) > most for c in {*left, *right}):
        return False
    return all(plainly_compatible(tree, left[c][0], right[c][0], alpha) for c in {*left} & {*right} if None not in (left[c][0], right[c][0]))


def test_remembered_pairs_change_no_state(monkeypatch):
    rng = random.Random(9)
    sets = [["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) + "c" * rng.randrange(6) for _ in range(rng.randrange(1, 400))] for _ in range(25)]
    got = [credentials.merged(credentials._Tree(values)) for values in sets]
    monkeypatch.setattr(credentials, "PAIRS", -1)
    assert got == [credentials.merged(credentials._Tree(values)) for values in sets]
    monkeypatch.setattr(credentials._Tree, "compatible", lambda tree, a, b, alpha, apart=None: plainly_compatible(tree, a, b, alpha))
    assert got == [credentials.merged(credentials._Tree(values)) for values in sets]


def test_a_deep_tree_is_merged_in_few_comparisons(monkeypatch):
    """Beginnings that get longer one by one: a pair found apart is not walked to its end again."""
    calls, alike = [0], credentials._Tree.alike
    monkeypatch.setattr(credentials._Tree, "alike", lambda *a: calls.__setitem__(0, calls[0] + 1) or alike(*a))
    tree = credentials._Tree.of_counts(1750, [("k" * i, 1750 - 2 * i, 0) for i in range(1, 501)], 4)
    states = len(tree.through)
    credentials.merged(tree)
    assert states == 501 and calls[0] < 3 * states * states


def test_long_beginnings_are_counted_in_few_passes(spark, monkeypatch):
    passes, stored = [], credentials.stored
    monkeypatch.setattr(credentials, "stored", lambda df, name: passes.append(name) or stored(df, name))
    found = spark.createDataFrame([("assign", "k" * n + c) for n in (100, 511, 600) for c in "ab"], "kind string, value string")
    rows = {text: (n, ends) for text, n, ends in credentials._beginnings(found, {"assign": 2})["assign"]}
    assert passes.count("beginnings") <= 7 and {len(t) for t in rows} == set(range(1, credentials.LONGEST + 1))
    assert rows["k" * 100] == (6, 0) and rows["k" * 100 + "a"] == (1, 1) and rows["k" * 512] == (2, 0) and rows["k" * 511 + "b"] == (1, 1)
