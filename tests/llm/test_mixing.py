import collections

from pyspark.sql import functions as F

from roadweave.llm import mixing


def water(sizes):
    """Targets by brute force: raise the level until all words are placed."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        new = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= new


def make(spark, per_source):
    rows = [(i * 100 + k, " ".join(["w"] * n), source) for i, (source, lengths) in enumerate(per_source.items()) for k, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_totals(spark):
    given = {"a": [3] * 40 + [7] * 30, "b": [5] * 60, "c": [2, 9, 11] * 20, None: [4] * 50, "Z": [1]}
    rows = mixing.copies(make(spark, given)).collect()
    sizes = {s: sum(v) for s, v in given.items()}
    expect = water(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - expect[r.source]) < 1e-6
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert abs(sum(expect.values()) - sum(sizes.values())) < 1e-6
    for s in given:
        assert abs(taken[s] - expect[s]) <= max(given[s]), s


def test_reruns_agree_and_blocks_do_not_change_totals(spark):
    docs = make(spark, {"a": list(range(1, 90)), "b": [3] * 300})
    first = {(r.doc_id): r.copies for r in mixing.copies(docs, block=16).collect()}
    again = {(r.doc_id): r.copies for r in mixing.copies(docs.repartition(7), block=16).collect()}
    assert first == again
    rows = mixing.copies(docs, block=16).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.max("target").alias("x")).collect()
    assert all(abs(r.t - r.x) <= 90 for r in rows)


def test_expectation_is_kept(spark):
    docs = make(spark, {"a": [5] * 64, "b": [5] * 64})
    total = collections.Counter()
    for seed in range(4):
        for r in mixing.copies(docs, seed=seed).where("source = 'b'").collect():
            total[r.doc_id] += r.copies
    assert 0.3 < sum(total.values()) / 64 / 4 < 0.9 and len([v for v in total.values() if 0 < v < 4]) > 30


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.copies(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: r.size for r in rows if r.doc_id in (2, 3, 5)} == {2: 0, 3: 0, 5: 0}
    assert mixing.copies(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r.copies for r in rows)


def test_main_path_is_native(spark, odd_docs):
    plan = mixing.copies(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def naive_fold(members, seed_of):
    """The pairs in turn, as plain arithmetic: (carry, done)."""
    carry, done = dict(members[0]), []
    for m in members[1:]:
        i, j = carry, dict(m)
        fill_i, drain_j, drain_i, fill_j = (1 - i["p"]) * i["size"], j["p"] * j["size"], i["p"] * i["size"], (1 - j["p"]) * j["size"]
        up, down = min(fill_i, drain_j), min(drain_i, fill_j)
        before = i["p"] * i["size"] + j["p"] * j["size"]
        if seed_of(i, j) * (up + down) < down:
            i["p"], j["p"], i_done = (1.0, j["p"] - up / j["size"], True) if fill_i <= drain_j else (i["p"] + up / i["size"], 0.0, False)
        else:
            i["p"], j["p"], i_done = (0.0, j["p"] + down / j["size"], True) if drain_i <= fill_j else (i["p"] - down / i["size"], 1.0, False)
        assert abs(i["p"] * i["size"] + j["p"] * j["size"] - before) < 1e-9
        carry, gone = (j, i) if i_done else (i, j)
        done.append(gone)
    return carry, done


def test_rounding_is_the_naive_one(spark):
    """One block: the SQL fold against plain arithmetic with the same random numbers."""
    members = [{"key": k, "dup": 1, "size": 3 + k % 7, "p": round(0.1 + 0.8 * ((k * 37) % 11) / 11, 3)} for k in range(40)]
    df = spark.createDataFrame([(members,)], "m array<struct<key: long, dup: long, size: long, p: double>>")
    got = df.select(mixing._fold(F.col("m"), 8).alias("f")).collect()[0].f
    pairs = spark.createDataFrame([(a["key"], b["key"]) for a in members for b in members], "a long, b long")
    unit = {(r.a, r.b): r.u for r in pairs.select("a", "b", mixing._unit(F.lit(8), F.col("a"), F.lit(1).cast("long"), F.col("b"), F.lit(1).cast("long")).alias("u")).collect()}
    carry, done = naive_fold(members, lambda i, j: unit[i["key"], j["key"]])
    assert (got.carry.key, round(got.carry.p, 9)) == (carry["key"], round(carry["p"], 9))
    assert [(d.key, round(d.p, 9)) for d in got.done] == [(d["key"], round(d["p"], 9)) for d in done]
    assert all(d.p in (0.0, 1.0) for d in got.done)


def test_rows_that_repeat_are_counted(spark, monkeypatch):
    """Rows alike in all columns, and rows of one id, source and size with other texts."""
    monkeypatch.setattr(mixing, "REPEATS", 16)
    same = [(1, "one two three", "a", "x")] * 100
    other = [(2, f"word{i} two", "a", "x") for i in range(20)] + [(3, "b c d e", "b", None), (3, "b c d e", "b", "y"), (None, None, None, None), (None, None, None, None)]
    docs = spark.createDataFrame(same + other, "doc_id long, text string, source string, extra string")
    rows = mixing.copies(docs).collect()
    assert len(rows) == len(same + other) and sorted(r["dup"] for r in rows if r.doc_id == 1) == list(range(1, 101))
    mixed = mixing.mix(docs)
    got = collections.Counter((r.doc_id, r.text, r.source, r.extra) for r in mixed.collect())
    assert mixed.columns == docs.columns and sum(got.values()) == sum(r.copies for r in rows) and set(got) <= set(same + other)
    assert got == collections.Counter((r.doc_id, r.text, r.source, r.extra) for r in mixing.mix(docs.repartition(5)).collect())
    assert got[1, "one two three", "a", "x"] == sum(r.copies for r in rows if r.doc_id == 1)


def test_many_sources_are_numbered_in_order(spark):
    sizes = {f"s{i:04d}": 1 + (i * 7) % 50 for i in range(900)}
    sizes[None] = 9
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df.repartition(9)).collect()}
    expect = water(sizes)
    assert all(abs(got[s] - expect[s]) < 1e-6 for s in sizes) and len(got) == len(sizes)


def test_rows_that_differ_in_nested_values_are_told_apart(spark):
    """Maps, maps inside structs and arrays, nulls at other places, and a column with a backtick in its name."""
    schema = "doc_id long, text string, source string, m map<string,string>, n struct<a: map<string,int>, b: string>, `o``d.d` array<map<string,int>>, p array<int>"
    base = (1, "a b c", "s", {"k": "1"}, ({"x": 1}, None), [{"y": 1}], [1, None])
    others = [(3, {"k": "2"}), (3, {"k": None}), (3, None), (3, {"k": "1", "l": "1"}), (4, ({"x": 2}, None)), (4, ({"x": 1}, "b")), (4, None), (5, [{"y": 2}]), (5, [{"y": 1}, None]), (6, [None, 1]), (6, []), (6, None)]
    rows = [base] + [tuple(v if i == at else x for i, x in enumerate(base)) for at, v in others]
    df = spark.createDataFrame(rows, schema)
    assert df.select(mixing._row_hash(df)).distinct().count() == len(rows)
    got = mixing.mix(df, weights=(1,)).collect()  # one source: each row once
    assert sorted(map(repr, got)) == sorted(map(repr, df.collect()))
    turned = spark.createDataFrame([(1, {"a": 1, "b": 2})], "doc_id long, m map<string,int>").unionByName(spark.sql("select 1L doc_id, map('b', 2, 'a', 1) m"))
    assert turned.select(mixing._row_hash(turned)).distinct().count() == 1
