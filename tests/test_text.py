import random
import re

import model
from pyspark.sql import functions as F

from blackbar.functions.patterns import TOKEN, collect_dictionary
from blackbar.operators import text as T
from blackbar.operators import vault as V
from blackbar.plans import wide_dictionary
from blackbar.plans.skew import salted_join


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, t string")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_basic_redaction(spark):
    vault = V.vault_from_lists(spark, ["password", "secret"])
    df = texts(spark, ["my password is secret", "", "clean", "Password"])
    assert column(T.redact_text(df, "t", vault), "t") == [
        "my [REDACTED] is [REDACTED]", "", "clean", "Password",
    ]


def test_clean_text_is_one_segment(spark):
    vault = V.vault_from_lists(spark, ["password", "secret"])
    rows = T.segment_text(texts(spark, ["prefix suffix", ""]), ["id"], "t", vault).collect()
    assert [tuple(r) for r in rows] == [(0, 0, "Input", "prefix suffix", 0, 13, None)]


def test_earliest_end_shadow_and_longest(spark):
    for patterns, text, expected in [
        (["password", "pass"], "password", "[REDACTED]word"),
        (["abcd", "bc"], "abcd", "a[REDACTED]d"),
        (["bc", "abc"], "abc", "[REDACTED]"),
    ]:
        vault = V.vault_from_lists(spark, patterns)
        assert column(T.redact_constant(texts(spark, [text]), "t", vault), "t") == [expected]
    vault = V.vault_from_lists(spark, ["bc", "abc"])
    found = T.find_matches(texts(spark, ["abc"]), ["id"], "t", vault).collect()
    assert [tuple(r) for r in found] == [(0, 0, 1, 0, 3)]


def test_quoting(spark):
    patterns = ["a.b", "$5", "\\E", "+1", "[x]", "^z", "a|b", "é-", "#", "a b\n"]
    samples = ["a.b axb", "$5 5", "\\Q\\E", "+1 1", "[x] x", "^z z", "a|b a", "é- e-", "#\\", "a b\n."]
    replacement = ["$0\\", "<\"1\">"] * 5
    vault = V.vault_from_lists(spark, patterns, replacement)
    df = texts(spark, samples)
    assert column(T.redact_text(df, "t", vault), "t") == [
        model.redact(patterns, s, replacement) for s in samples
    ]
    uniform = V.vault_from_lists(spark, patterns, ["$0\\"] * 10)
    assert column(T.redact_text(df, "t", uniform), "t") == [
        model.redact(patterns, s, "$0\\") for s in samples
    ]
    assert column(T.redact_constant(df, "t", vault, "\\$1"), "t") == [
        model.redact(patterns, s, "\\$1") for s in samples
    ]


def test_empty_vault_changes_nothing(spark):
    vault = spark.createDataFrame([], "pattern_id int, pattern string, replacement string")
    vault = V.vault_table(vault)
    df = texts(spark, ["abc", ""])
    assert column(T.redact_text(df, "t", vault), "t") == ["abc", ""]
    assert column(T.redact_constant(df, "t", vault), "t") == ["abc", ""]
    assert T.filter_matching(df, "t", vault).count() == 0
    assert T.filter_matching(df, "t", vault, negate=True).count() == 2
    assert T.find_matches(df, ["id"], "t", vault).count() == 0
    assert T.segment_text(df, ["id"], "t", vault).count() == 1
    assert T.pattern_counters(df, "t", vault, []).count() == 0


def random_case(rng, alphabet="abé"):
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, n)))
    return [word(4) for _ in range(rng.randint(1, 5))], [word(14) for _ in range(25)] + [""]


def test_random_dictionaries_agree_with_brute_force(spark):
    rng = random.Random(7)
    for _ in range(6):
        patterns, samples = random_case(rng)
        replacement = [f"<{i}>" for i in range(len(patterns))]
        vault = V.vault_from_lists(spark, patterns, replacement)
        df = texts(spark, samples)
        d = collect_dictionary(vault)
        assert [e.pattern_id for e in d.live] == model.live(patterns)
        table = sorted(r.pattern_id for r in V.live_patterns(vault).collect())
        assert table == model.live(patterns)

        expected = []
        for i, s in enumerate(samples):
            at = [len(s[:k].encode()) for k in range(len(s) + 1)]
            for no, (b, e, p) in enumerate(model.find(patterns, s)):
                expected.append((i, no, p, at[b], at[e]))
        for plan in (
            T.find_matches(df, ["id"], "t", d),
            wide_dictionary.find_matches(df, ["id"], "t", vault),
        ):
            assert sorted(tuple(r) for r in plan.collect()) == expected
        wanted = [model.redact(patterns, s, replacement) for s in samples]
        assert column(T.redact_text(df, "t", d), "t") == wanted
        assert column(wide_dictionary.redact(df, "t", vault, "t"), "t") == wanted
        constant = column(T.redact_constant(df, "t", d), "t")
        assert constant == [model.redact(patterns, s, TOKEN) for s in samples]

        segments = T.segment_text(df, ["id"], "t", d)
        joined = {}
        for r in sorted(segments.collect(), key=lambda r: (r.id, r.segment_no)):
            assert r.end_byte > r.start_byte
            joined[r.id] = joined.get(r.id, "") + r.value
        assert [joined.get(i, "") for i in range(len(samples))] == constant
        check = T.reconcile_bytes(
            df, T.redact_constant(df, "t", d), segments, ["id"], "t", "t", d
        )
        assert check.where("not reconciled").count() == 0
        hit = T.filter_matching(df, "t", d)
        assert sorted(r.id for r in hit.collect()) == sorted(
            i for i, s in enumerate(samples) if model.find(patterns, s)
        )


def test_long_text_offsets(spark):
    # More matches than one block of the running sums holds.
    patterns = ["ab", "é"]
    text = "xab éé" * 700
    df = texts(spark, [text])
    vault = V.vault_from_lists(spark, patterns)
    found = T.find_matches(df, ["id"], "t", vault).orderBy("match_no").collect()
    expected = model.find([p.encode() for p in patterns], text.encode())[:50]
    assert len(found) == 2100
    assert [(r.start_byte, r.end_byte, r.pattern_id) for r in found[:50]] == expected
    data = text.encode()
    assert all(data[r.start_byte:r.end_byte].decode() == patterns[r.pattern_id] for r in found)
    last = T.segment_text(df, ["id"], "t", vault).orderBy(F.desc("segment_no")).first()
    assert last.end_byte == len(data)


def test_wide_dictionary_beyond_the_regex_limit(spark):
    patterns = [f"k{i:04d}x" for i in range(2500)]
    vault = V.vault_from_lists(spark, patterns, [f"<{i}>" for i in range(2500)])
    df = texts(spark, ["a k0001x b k2499xk0000x", "k001x", "k9999x"])
    assert column(T.redact_text(df, "t", vault, keys=["id"]), "t") == [
        "a <1> b <2499><0>", "k001x", "k9999x",
    ]
    assert T.find_matches(df, ["id"], "t", vault).count() == 3
    assert [r.id for r in T.filter_matching(df, "t", vault, keys=["id"]).collect()] == [0]


def test_json_text_stays_valid(spark):
    vault = V.vault_from_lists(spark, ["abc", "d"], ['say "hi"\\', "\n"])
    df = texts(spark, ['{"a":"xabcd"}'])
    out = T.redact_json_text(df, "t", vault).withColumn("v", F.from_json("t", "a string"))
    row = out.first()
    assert row.v.a == 'xsay "hi"\\\n'


def test_parse_pattern_list(spark):
    df = spark.createDataFrame(
        [(0, " a , ,b ,　c d\n"), (1, None), (2, " , ")], "id int, p string"
    )
    rows = V.parse_pattern_list(df, "p", ["id"]).orderBy("id", "pattern_id").collect()
    assert [(r.id, r.pattern_id, r.pattern) for r in rows] == [
        (0, 0, "a"), (0, 1, "b"), (0, 2, "c d"),
        (1, 0, "password"), (1, 1, "secret"), (1, 2, "ssn"),
    ]


def test_vault_errors(spark):
    import pytest

    with pytest.raises(ValueError):
        V.vault_from_lists(spark, ["a"], [])
    with pytest.raises(ValueError):
        V.vault_from_lists(spark, ["a", ""])
    bad = spark.createDataFrame([(0, "", "x")], "pattern_id int, pattern string, replacement string")
    with pytest.raises(Exception, match="must not be empty"):
        V.vault_table(bad).collect()


def test_counters(spark):
    vault = V.vault_from_lists(spark, ["a", "b"])
    df = spark.createDataFrame(
        [(0, "aab"), (0, "c"), (1, "b"), (1, None)], "g int, t string"
    )
    rows = {tuple(r) for r in T.redaction_counters(df, "t", vault, ["g"]).collect()}
    assert rows == {(0, 2, 1, 3), (1, 2, 1, 1)}
    rows = {tuple(r) for r in T.pattern_counters(df, "t", vault, ["g"]).collect()}
    assert rows == {(0, 0, 2), (0, 1, 1), (1, 1, 1)}


def test_large_dictionary_null_and_repeated_keys(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 7)))
    patterns = list(dict.fromkeys(word() for _ in range(5000)))
    replacement = [f"<{i}>" for i in range(len(patterns))]
    texts_ = [" ".join(rng.choice(patterns) + rng.choice(["", "x"]) for _ in range(8)) for _ in range(6)]
    rows = [(1, texts_[0]), (1, texts_[1]), (None, texts_[2]), (None, texts_[3]), (2, None), (3, texts_[4])]
    df = spark.createDataFrame(rows, "id int, t string")
    vault = V.vault_from_lists(spark, patterns, replacement)
    wanted = sorted(str(t and model.redact(patterns, t, replacement)) for _, t in rows)
    for plan in (T.redact_text(df, "t", vault), wide_dictionary.redact(df, "t", vault, "t")):
        assert sorted(str(r.t) for r in plan.collect()) == wanted
    constant = sorted(str(t and model.redact(patterns, t, TOKEN)) for _, t in rows)
    assert sorted(str(r.t) for r in T.redact_constant(df, "t", vault).collect()) == constant
    n = sum(len(model.find(patterns, t)) for _, t in rows if t)
    assert T.find_matches(df, ["id"], "t", vault).count() == n
    assert wide_dictionary.find_matches(df, ["id"], "t", vault).count() == n
    counts = T.redaction_counters(df, "t", vault, ["id"]).collect()
    assert sum(r.matches for r in counts) == n
    kept = T.filter_matching(df, "t", vault).count()
    assert kept + T.filter_matching(df, "t", vault, negate=True).count() == len(rows)


def test_time_is_linear_in_the_text(spark):
    import time

    vault = V.vault_from_lists(spark, ["ab", "é"])
    took = []
    for n in (20_000, 20_000, 80_000):
        df = texts(spark, ["xab éyyyyyyyyyyyyyyy" * n])
        began = time.time()
        assert T.segment_text(df, ["id"], "t", vault).count() == 4 * n + 1
        took.append(time.time() - began)
    assert took[2] < 12 * took[1] + 2


def test_long_patterns(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abc") for _ in range(8000))
    patterns = [long, long[:5000] + "Z", "key", long[1:700] + "Y"]
    vault = V.vault_from_lists(spark, patterns)
    d = collect_dictionary(vault)
    assert [e.pattern_id for e in d.live] == [0, 1, 2, 3]
    samples = ["x" + long + "y", long[:7999], "q" + long[:4999], "a key", long[1:600], ""]
    df = texts(spark, samples)
    assert column(T.redact_constant(df, "t", d), "t") == [
        "x" + TOKEN + "y", samples[1], samples[2], "a " + TOKEN, samples[4], ""
    ]
    pending = df.select("id", d.pending_bytes(F.col("t")).alias("n"))
    words = [w[:k] for w in patterns for k in range(1, len(w))]
    by_text = {w: len(w) for w in words}
    expected = []
    for s in samples:
        expected.append(max((n for n in range(1, len(s) + 1) if s[len(s) - n :] in by_text), default=0))
    assert [r.n for r in pending.orderBy("id").collect()] == expected


def test_a_large_dictionary_is_not_broadcast(spark, tmp_path):
    """Files of a size that Spark would broadcast unpack to many rows, and to more once per salt."""
    ids = spark.range(200_000)
    ids.selectExpr("id", "substr(md5(cast(id as string)), 1, 8) as p").write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).selectExpr(
        "id as pattern_id", "p as pattern", "cast(null as string) as replacement"
    )
    live = V.live_patterns(V.vault_table(rows))
    assert live.count() > 0
    assert "Broadcast" not in live._jdf.queryExecution().executedPlan().toString()


def test_a_salted_join_does_not_broadcast_what_the_salts_make_large(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "id * 3 as n").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    rows = spark.range(50).withColumnRenamed("id", "row").withColumn("id", F.col("row") * 2)
    joined = salted_join(rows, facts, ["id"], "row")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert sorted(r.n for r in joined.collect()) == [6 * i for i in range(50)]


def test_matches_of_a_frequent_pattern_are_not_dealt_by_pattern(spark, monkeypatch):
    vault = V.vault_from_lists(spark, ["the", "é", "ab"], ["<$1>", "", "\\"])
    df = texts(spark, ["the é ab", "the the", "", None, "the the", "tha"])
    expected = ["<$1>  \\", "<$1> <$1>", "", None, "<$1> <$1>", "tha"]
    for limit in (wide_dictionary._BROADCAST_BYTES, 0):  # a large vault is salted
        monkeypatch.setattr(wide_dictionary, "_BROADCAST_BYTES", limit)
        out = wide_dictionary.redact(df, "t", vault, "t")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[pattern_id#\d+\], \[pattern_id#\d+\], Inner", plan)
        assert column(out, "t") == expected
