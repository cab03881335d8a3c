from compare import SMALL
from pyspark.sql import functions as F

from tablevault.functions import scalars as X
from tablevault.functions.fingerprint import FINGERPRINT, portable_digest, table_digest, with_fingerprint
from tablevault.operators.selection import parse_names, select_names, select_tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, rows, ddl, column):
    return [r["v"] for r in spark.createDataFrame([(r,) for r in rows], ddl).select(column.alias("v")).collect()]


def test_sizes(spark):
    got = values(spark, [0, 5242, 5243, 1048576, 3221225472, None], "n bigint", X.size_hundredths("n"))
    assert got == [0, 0, 1, 100, 307200, None]
    assert values(spark, [0, 5243, None], "n bigint", X.size_mb_or_na("n")) == ["N/A", "0.01", "N/A"]
    texts = ["50GB", "20m", "20971520", " 7 kb ", "1.5g", "x", "", "99999999999p", None]
    want = [53687091200, 20971520, 20971520, 7168, None, None, None, None, None]
    assert values(spark, texts, "s string", X.parse_size("s")) == want


def test_texts(spark):
    assert values(spark, ["20m", " 7 ", "abc", "-3", "", "99999999999"], "s string", X.leading_int("s")) == [20, 7, None, -3, None, None]
    assert values(spark, ["a,b, c", "a,", "", None], "s string", X.split_names("s")) == [["a", "b", "c"], ["a"], [], None]
    assert values(spark, ["/a/b.gz", "b.gz", "/b", "/a/"], "s string", X.dir_name("s")) == ["/a", ".", "/", "/a"]
    assert values(spark, ["/a/b.gz", "b.gz"], "s string", X.base_name("s")) == ["b.gz", "b.gz"]
    secret = '{"password" : "a\\"b","x":"y"}'
    assert values(spark, [secret], "s string", X.redact("s")) == ['{"password" : "***","x":"y"}']
    assert values(spark, ["postgres", "mariadb", "oracle"], "s string", X.canonical_db_type("s")) == ["postgresql", "mysql", None]
    assert values(spark, ["", None, "x"], "s string", X.default_text("s", "d")) == ["d", "d", "x"]
    assert values(spark, [0, None, 5], "n int", X.default_number("n", 9)) == [9, 9, 5]
    assert values(spark, [1, 5, 995, 0, None, 123456], "n bigint", X.seconds_text("n")) == ["0.00", "0.01", "1.00", None, None, "123.46"]
    assert one(spark, X.ratio_percent(F.lit(25), F.lit(200))) == "87.5"
    assert one(spark, X.ratio_percent(F.lit(300), F.lit(200))) == "-50.0"
    assert one(spark, X.ratio_percent(F.lit(3), F.lit(0))) is None
    assert one(spark, X.iso_stamp(F.lit("2024-01-02 03:04:05.6789").cast("timestamp"))) == "2024-01-02T03-04-05-678Z"
    assert one(spark, X.json_object(a=F.lit(1), b=F.lit(None).cast("string"))) == '{"a":1}'
    assert one(spark, X.prefix(F.lit("é" * 20), 16)) == "é" * 16
    assert one(spark, X.yes_no(F.lit(None).cast("boolean"))) == "No"
    assert one(spark, X.first_part(F.lit("PostgreSQL 16.1, compiled"))) == "PostgreSQL 16.1"
    assert len(one(spark, X.surrogate_id())) == 36


def fingerprints(spark, rows, ddl):
    df = with_fingerprint(spark.createDataFrame(rows, ddl))
    return [tuple(r[c] for c in FINGERPRINT) for r in df.collect()]


def test_fingerprints_tell_rows_apart(spark):
    pairs = [(None, 1), (1, None), (None, None), (1, 1), (0, 0)]
    assert len(set(fingerprints(spark, pairs, "a int, b int"))) == 5
    texts = [("a, b", "c"), ("a", "b, c"), ("", None), (None, ""), ("", "")]
    assert len(set(fingerprints(spark, texts, "a string, b string"))) == 5
    arrays = [([1, None],), ([None, 1],), ([1],), ([],), (None,), ([1, 1],)]
    assert len(set(fingerprints(spark, arrays, "a array<int>"))) == 6
    nested = [([[1], [2]],), ([[1, 2]],), ([[1, 2], []],), ([[], [1, 2]],), ([None, [1, 2]],)]
    assert len(set(fingerprints(spark, nested, "a array<array<int>>"))) == 5
    structs = [((None, 1),), ((1, None),), (None,), ((None, None),)]
    assert len(set(fingerprints(spark, structs, "a struct<x:int,y:int>"))) == 4
    maps = [({"a": 1, "b": 2},), ({"b": 2, "a": 1},), ({"a": 2, "b": 1},), ({"a": None},), ({},), (None,)]
    assert len(set(fingerprints(spark, maps, "a map<string,int>"))) == 5
    assert len(set(fingerprints(spark, [(0.0,), (-0.0,)], "a double"))) == 1
    assert len(set(fingerprints(spark, [(float("nan"),), (float("nan"),)], "a double"))) == 1


def test_fingerprint_does_not_depend_on_nullability(spark):
    strict = spark.range(3).select("id", F.array(F.col("id")).alias("a"), F.struct("id").alias("r"))
    loose = spark.createDataFrame(strict.collect(), "id bigint, a array<bigint>, r struct<id:bigint>")
    assert not strict.schema["id"].nullable and loose.schema["id"].nullable
    assert table_digest(strict).first() == table_digest(loose).first()


def test_fingerprint_has_no_collision_on_data(spark):
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    assert with_fingerprint(df).select(*FINGERPRINT).distinct().count() == df.distinct().count()


def test_digest_ignores_order_and_layout_but_counts_copies(spark):
    df = spark.read.parquet(f"{SMALL}/orders.parquet")
    for digest in (table_digest, portable_digest):
        base = digest(df).first()
        assert digest(df.repartition(5).sortWithinPartitions("o_custkey")).first() == base
        assert digest(df.unionAll(df.limit(1))).first() != base
        assert digest(df.limit(0)).first()[0] == 0


def test_selection_rules(spark):
    have = ["a", "b", "c1", "c2"]
    assert select_names(have) == have
    assert select_names(have, [], ["b"]) == ["a", "c1", "c2"]
    assert select_names(have, ["a", "c*"], ["c2"]) == ["a", "c1"]
    assert select_names(have, ["a"], ["a"]) == []
    assert parse_names("a,b, c,") == ["a", "b", "c"] and parse_names("") == [] and parse_names(None) is None
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "table_name string")
    got = select_tables(frame(*have), frame("a", "b", "a"), frame("b", "zz"))
    assert [r[0] for r in got.collect()] == ["a"]


def test_stamps_do_not_depend_on_the_session_zone(spark):
    from tablevault.functions import scalars as X

    rows = spark.sql("select timestamp_ntz'2024-01-02 03:04:05.678' n, timestamp_micros(1704164645678000) t")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = rows.select(X.iso_stamp("n"), X.iso_stamp("t"), X.epoch_millis("n"), X.epoch_millis("t")).first()
            assert tuple(got) == ("2024-01-02T03-04-05-678Z",) * 2 + (1704164645678,) * 2, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_secrets_leave_failure_texts():
    from tablevault.functions.scalars import redact_secrets

    text = 'jdbc:postgresql://u:pw1@h/db?user=u&password=pw2 {"password": "p\\"w3"} Passwd = \'pw4\' ok=1'
    got = redact_secrets(text)
    assert not any(f"pw{i}" in got for i in (1, 2, 4)) and "w3" not in got and "ok=1" in got and "u:***@h" in got


def test_sealed_digest_is_additive_and_keyed(spark):
    from tablevault.functions import sealed

    rows = [(i, f"v{i % 5}", None if i % 7 == 0 else i * 2) for i in range(60)] + [(1, "v1", 2)] * 3
    df = spark.createDataFrame(rows, "a int, b string, c long")
    value = lambda d, key="k": sealed.sealed_digest(sealed.lanes(d, key)).first()
    assert value(df) == value(df.repartition(5)) and value(df)["row_count"] == 63
    assert value(df) != value(df, "other") and value(df)["digest"] != value(df.limit(62))["digest"]
    assert value(df)["digest"] != value(df.dropDuplicates())["digest"]
    more, less = df.where("a < 20"), df.where("a between 5 and 9")
    left = df.where("not a < 20")
    whole = sealed.combined((1, sealed.lanes(left, "k")), (1, sealed.lanes(more, "k")))
    assert sealed.sealed_digest(whole).first() == value(df)
    without = sealed.combined((1, sealed.lanes(df, "k")), (-1, sealed.lanes(less, "k")))
    assert sealed.sealed_digest(without).first() == value(df.where("not a between 5 and 9"))
    empty = sealed.lanes(df.limit(0), "k")
    assert empty.count() == sealed.LANES and sealed.sealed_digest(empty).first()["row_count"] == 0
    want = sum(sealed.expand(t.encode(), b"k") for t in ["1:1", "1:2"]) % sealed.MODULUS
    got = {r["lane"]: r["value"] for r in sealed.lanes(spark.range(1, 3), "k").collect()}
    assert [got[i] for i in range(sealed.LANES)] == want.tolist()


def test_sealed_rows_of_one_part_are_hashed_by_many_tasks(spark):
    """A small file comes as one task; its rows are dealt out before they are hashed, and the vector is that of the rows, copies and nulls included."""
    import numpy as np

    from tablevault.functions import sealed

    rows = [(1, "a"), (1, "a"), (None, "ü"), (2, None), (None, None)] * 3 + [(i, "x" * i) for i in range(600)]
    vector = sealed.lanes(spark.createDataFrame(rows, "a int, b string").coalesce(1), "clé: 1")
    plan = vector._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange RoundRobinPartitioning" in plan[plan.index("MapInArrow") :]
    part = lambda v: "-1:" if v is None else f"{len(str(v))}:{v}"
    want = sum(sealed.expand(f"{part(a)}{part(b)}".encode(), "clé: 1".encode()) for a, b in rows) % sealed.MODULUS
    found = vector.orderBy("lane").collect()
    assert np.array_equal([r["value"] for r in found], want) and {r["row_count"] for r in found} == {len(rows)}
