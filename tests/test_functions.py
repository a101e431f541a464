from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from assayer.functions import documents, numbers
from assayer.operators import lineage, search, surrogate


def test_authored_decimals(spark):
    cases = {
        "1e3": "1000", "-0.10": "-0.1", "00012.3400": "12.34", "1.5E-4": "0.00015", "0.000": "0", "-0": "0", "120e-1": "12", "1e-2": "0.01",
        ".5": None, "5.": None, "+1": None, "": None, "1e": None, "1 ": None, "1e99999": None, "--1": None,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in numbers.normalize_numbers(df, "t").collect():
        assert r.canonical == r.want and (r.number_problem is None) == (r.want is not None), r
        assert r.is_canonical == (r.want == r.t)


def test_rationals_agree_with_fractions(spark):
    values = [Fraction(a, b) for a in (-7, -1, 0, 3, 10**17) for b in (1, 2, 9, 10**15 + 1)] + [Fraction(10**37, 3), Fraction(10**37, 7)]
    rows = [(i, j, a.numerator, a.denominator, b.numerator, b.denominator) for i, a in enumerate(values) for j, b in enumerate(values)]
    kinds = "i int, j int, an decimal(38,0), ad decimal(38,0), bn decimal(38,0), bd decimal(38,0)"
    from decimal import Decimal

    df = spark.createDataFrame([(i, j, *map(Decimal, r)) for i, j, *r in rows], kinds)
    a, b = numbers.rational(F.col("an"), F.col("ad")), numbers.rational(F.col("bn"), F.col("bd"))
    out = df.select("i", "j", numbers.reduced(numbers.exact_add(a, b)).alias("s"), numbers.reduced(numbers.exact_mul(a, b)).alias("m"), numbers.exact_div(a, b).alias("q"), numbers.exact_cmp(a, b).alias("c"))
    for r in out.collect():
        x, y = values[r.i], values[r.j]
        assert r.c == (x > y) - (x < y)
        for got, want in ((r.s, x + y), (r.m, x * y), (r.q, x / y if y else None)):
            if got is not None and got[0] is not None:
                assert Fraction(int(got[0]), int(got[1])) == want
            else:
                assert want is None or max(abs(x.numerator * y.denominator), abs(y.numerator * x.denominator), x.denominator * y.denominator, abs(x.numerator * y.numerator), x.denominator * abs(y.numerator)) >= 10**32


def test_quotients_keep_all_digits(spark):
    from decimal import Decimal

    pairs = [(n, d) for n in (10**38 - 1, -(10**38 - 2), 10**37, 6, -9, 0) for d in (1, 2, 3, 9, 999_999, 10**6, 3 * 10**20, 10**38 - 1)] + [(3**70, 3**79), (2**126, 2**5), (7 * 10**36, 7)]
    df = spark.createDataFrame([(i, Decimal(n), Decimal(d)) for i, (n, d) in enumerate(pairs)], "i int, n decimal(38,0), d decimal(38,0)")
    for r in df.select("i", numbers.reduced(numbers.rational(F.col("n"), F.col("d"))).alias("q")).collect():
        want = Fraction(*pairs[r.i])
        assert (int(r.q.num), int(r.q.den)) == (want.numerator, want.denominator), pairs[r.i]


def test_document_differences(spark):
    cases = [
        ('{"a":1}', '{"a":2}', {("/a", "replaced")}), ('{"a":{"b":1}}', '{"a":{"b":1,"c":{"d":2}}}', {("/a/c", "added")}), ('{"x":[1,2]}', '{"x":[1,2,3]}', {("/x", "replaced")}),
        ('{"x":[1,{"y":2}]}', '{"x":[1,{"y":3}]}', {("/x/1/y", "replaced")}), ('{"a~b":1,"c/d":2}', '{"c/d":3}', {("/a~0b", "removed"), ("/c~1d", "replaced")}),
        ('{"a":1}', '{"a":"1"}', {("/a", "replaced")}), ('{"a":{}}', '{"a":[]}', {("/a", "replaced")}), ('{"a":null}', '{"a":null}', set()), ("[]", "{}", {("", "replaced")}),
    ]
    side = lambda k: spark.createDataFrame([(i, c[k]) for i, c in enumerate(cases)], "id int, doc string")
    got = {}
    for r in documents.diff_documents(side(0), side(1), "id", "doc").collect():
        got.setdefault(r.id, set()).add((r.pointer, r.change))
    assert got == {i: c[2] for i, c in enumerate(cases) if c[2]}


def test_canonical_json_refuses(spark):
    cases = {'{"b":1,"a":[true,null]}': None, '{"a":1.0}': "not_an_integer", '{"a":"1.0"}': None, '{"a":1e3}': "not_an_integer", "{": "not_json", '{"a":9007199254740992}': "integer_range", '{"a":"é"}': "not_nfc", '{"a":"é"}': None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in documents.canonicalize_documents(df, "t").collect():
        assert r.json_problem == cases[r.t] and (r.canonical is None) == (cases[r.t] is not None)
    assert documents.canonicalize_documents(df, "t").filter("t like '{\"b%'").first().canonical == '{"a":[true,null],"b":1}'


def test_ridge_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2)) * [1, 5] + 2
    y = 1 + x @ [0.5, -0.2] + rng.normal(size=60) * 0.1
    rows = [("r", i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))] + [("few", i, 1.0, 2.0, 3.0) for i in range(3)]
    df = spark.createDataFrame(rows, "requirement string, k int, a double, b double, y double")
    (m,) = surrogate.ridge_by_requirement(df, ["a", "b"], "y", ["requirement"], 2.0).collect()
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(m.coef, np.linalg.solve(z.T @ z + 2 * np.eye(2), z.T @ (y - y.mean()))) and np.isclose(m.intercept, y.mean())
    models = surrogate.bootstrap_models(df, "k", ["a", "b"], "y", ["requirement"], 16)
    assert models.filter("requirement = 'r'").count() == 16
    weights = df.select(surrogate.poisson_count(surrogate.hashed_draw(F.concat_ws("/", F.lit("1"), F.col("k").cast("string")))).alias("w"))
    assert 0.5 < weights.agg(F.avg("w")).first()[0] < 1.6
    slopes = {r.feature: r.slope for r in surrogate.sensitivity(spark.createDataFrame([m]), ["a", "b"], ["requirement"]).collect()}
    assert abs(slopes["a"] - 0.5) < 0.1 and abs(slopes["b"] + 0.2) < 0.05


def test_an_honest_log_and_one_change_each(spark):
    fields = "line, attempt_id, generation, parent_id, parent_sha256, record_sha256, case_id, input_id, state_sha256, derived_sha256, n_changes, n_derived_changes".split(", ")
    honest = [dict(zip(fields, r)) for r in [(1, "a", 0, None, None, "ha", 1, "i", "s", "s", 0, 0), (2, "b", 1, "a", "ha", "hb", 1, "i", "t", "t", 1, 1), (3, "c", 2, "b", "hb", "hc", 1, "i", "u", "u", 2, 2)]]
    kinds = "line int, attempt_id string, generation int, parent_id string, parent_sha256 string, record_sha256 string, case_id int, input_id string, state_sha256 string, derived_sha256 string, n_changes int, n_derived_changes int"

    def problems(rows):
        return {(r.line, r.problem) for r in lineage.validate_lineage(spark.createDataFrame([tuple(x[f] for f in fields) for x in rows], kinds)).collect()}

    assert problems(honest) == set()
    changes = [
        (1, {"generation": 1}, {(1, "root_generation"), (2, "generation_step")}), (1, {"n_changes": 1, "n_derived_changes": 1}, {(1, "root_changes")}), (2, {"parent_id": "z"}, {(2, "parent_missing")}),
        (2, {"line": 9}, {(3, "parent_not_earlier")}), (3, {"generation": 5}, {(3, "generation_step")}), (2, {"parent_sha256": "x"}, {(2, "parent_digest")}), (3, {"case_id": 2}, {(3, "fixed_identity")}),
        (3, {"input_id": "j"}, {(3, "candidate_input")}), (3, {"n_changes": 1}, {(3, "recorded_changes")}), (3, {"state_sha256": "x"}, {(3, "state_digest")}),
    ]
    for line, change, want in changes:
        assert problems([{**r, **change} if r["line"] == line else r for r in honest]) == want


def test_fold_of_small_gains(spark):
    values = [1, 2, 3, None, 4, 6, 5, 9, 9, 12]
    rows = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "arm string, line int, worst long")
    got = [(r.best, r.since) for r in search.best_so_far(rows, ["arm"], "worst", 2).orderBy("line").collect()]
    best, since, want = None, 0, []
    for v in values:
        since += 1
        if v is not None and (best is None or v > best + 2):
            best, since = v, 0
        want.append((best, since))
    assert got == want


def test_ancestors_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(60)], "node long, parent long")
    got = {(r.node, r.ancestor): r.depth for r in lineage.ancestors(edges).collect()}
    assert got == {(i, j): i - j for i in range(60) for j in range(i)}
