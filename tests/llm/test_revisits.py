import random

import pytest
from pyspark.sql import functions as F

from depotlens.llm import revisits

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, target string"


def brute(rows):
    """Status and target by looking at all responses; addresses are plain here."""
    out = []
    for i, url, ts, kind, etag, day, *_ in rows:
        if kind != "revisit":
            continue
        own = [r for r in rows if r[3] == "response" and url is not None and r[1] == url and ts is not None and r[2] is not None and r[2] < ts]
        if not own:
            out.append((i, None, "no_response"))
            continue
        then = max(own, key=lambda r: (r[2], r[0]))
        a, b = (x.removeprefix("W/") if x else None for x in (etag, then[4]))
        status = ("resolved" if a == b else "modified") if a and b else ("resolved" if day == then[5] else "modified") if day and then[5] else "unchecked"
        out.append((i, then[0], status))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        url = "a.com/hot" if rng.random() < 0.4 else rng.choice([f"a.com/{rng.randint(0, 80)}", None if i % 50 == 0 else "b.org/x"])
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        rows.append((i, url, None if i % 90 == 0 else rng.randint(0, 400), kind, rng.choice(['"a"', 'W/"a"', '"b"', "", None]), rng.choice(["d1", "d2", None]),
                     {"ETag": "x", "Content-Length": str(i), "Date": f"t{i}"} if i % 7 else None, "clash"))
    return rows


@pytest.mark.parametrize("bucket", [200_000, 100])
def test_agrees_with_looking_at_all(spark, rows, bucket):
    got = revisits.resolved(spark.createDataFrame(rows, SCHEMA), revisits.Settings(bucket)).collect()
    assert sorted((r.record_id, r.target_id, r.status) for r in got) == brute(rows)


def test_headers_are_renewed_where_permitted(spark):
    rows = [(1, "http://www.A.com:80/p/?b=2&utm_x=1&a=1#f", 5, "response", '"v"', None, {"Content-Type": "text/html", "Content-Length": "10", "DATE": "old", "date": "older", "Keep": "k"}, None),
            (2, "https://a.com/p?a=1&b=2", 9, "revisit", 'W/"v"', None, {"content-length": "0", "Date": "new", "X-More": "m"}, None)]
    got = revisits.resolved(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.address, r.target_id, r.status, r.headers) for r in got] == [
        ("a.com/p?a=1&b=2", 1, "resolved", {"content-type": "text/html", "content-length": "10", "keep": "k", "date": "new", "x-more": "m"})]


def test_empty_table(spark):
    assert revisits.resolved(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_bucket_holds_a_hot_address(spark):
    n = 60_000
    rows = spark.range(n).select(F.col("id"), F.lit("hot").alias("address"), F.col("id").alias("ts"), (F.col("id") % 3 == 0).alias("full"))
    got = revisits.latest_response(rows, revisits.Settings(5_000))
    assert got.filter("target <> id - id % 3").count() == 0 and got.count() == n - n // 3
