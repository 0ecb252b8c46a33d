"""Streams: arrivals in any order, late rows, restarts in the middle of a batch, windows and chains from live sessions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import sessions, verdicts
from riskloom.streaming import arrivals, live

START = dt.datetime(2026, 1, 1, 9, 0)
TEXTS = {
    "message": "URGENT: KYC expired, share OTP, update at http://sbi-verify.site.example.com/login", "url": "http://sbi-verify.site.example.com/login?otp=1&redirect=x",
    "upi": "upi://pay?pa=shop@upi&am=60000&tn=urgent%20refund%20claim%20now", "qr": "https://www.google.com/",
}


def _artefacts():
    """Eight users; user 0 has every third row. Sessions of some minutes, hours apart."""
    rng, rows = random.Random(5), []
    for k in range(120):
        user = "u0" if k % 3 == 0 else f"u{k % 8}"
        at = START + dt.timedelta(hours=2 * (k // 20), minutes=rng.randrange(0, 40), seconds=k)
        kind = list(TEXTS)[k % 4]
        rows.append((user, f"i{k:03d}", at, kind, TEXTS[kind]))
    rows.append((None, "n1", START, "message", TEXTS["message"]))
    rows.append((None, "n2", START, "upi", TEXTS["upi"]))
    return rows


def _put(spark, rows, path):
    spark.createDataFrame(rows, live.ARTEFACT).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(live.ARTEFACT).parquet(path)


def _plain(df, *columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))


VERDICT = ["chain_id", "n_stages", "n_flagged", "n_edges", "pattern", "risk_score", "classification", "indicators"]


def test_sessions_of_a_hot_user_and_of_no_user(spark):
    rows = _artefacts()
    found = sessions.sessionized(spark.createDataFrame(rows, live.ARTEFACT).withColumn("other", F.lit(1)), "30 minutes", slice_="1 hour").collect()
    assert len(found) == len(rows)
    want = {}
    for user in {r[0] or "" for r in rows}:
        last, place, start = None, 0, None
        for r in sorted((r for r in rows if (r[0] or "") == user), key=lambda r: (r[2], r[1])):
            if last is None or r[2] >= last + dt.timedelta(minutes=30):
                start, place = r[2], 0
            want[r[1]] = (f"{user}@{int(start.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)}", place)
            last, place = r[2], place + 1
    assert {r["item_id"]: (r["chain_id"], r["idx"]) for r in found} == want
    assert sessions.sessionized(spark.createDataFrame([], live.ARTEFACT)).count() == 0
    assert sessions.sessionized(spark.createDataFrame([("u", "x", None, "url", "a.b")], live.ARTEFACT)).count() == 0


def test_chains_of_a_stream_equal_the_batch(spark, tmp_path):
    rows, source, root = _artefacts(), f"{tmp_path}/in", f"{tmp_path}/out"
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    end = [("end", "z", START + dt.timedelta(days=9), "url", "a.example")]
    late = [("u0", "late1", START - dt.timedelta(days=30), "url", "http://late.example"), ("u1", "late2", None, "url", "http://late.example")]
    for part in (shuffled[:60], shuffled[60:], end, late + [("end", "zz", START + dt.timedelta(days=9), "url", "a.example")]):
        _put(spark, part, source)
        arrivals.accept(_stream(spark, source), root, f"{root}/_a", delay="2 days").awaitTermination()
        live.chain_sessions(arrivals.on_time(spark, root, live.ARTEFACT), root, f"{root}/_c", "30 minutes", "2 days").awaitTermination()
    batch = verdicts.chain_verdicts(sessions.sessionized(spark.createDataFrame(rows, live.ARTEFACT), "30 minutes"))
    got = arrivals.committed(spark, f"{root}/chains", live.CHAIN_VERDICT)
    assert _plain(got, *VERDICT) == _plain(batch, *VERDICT)
    assert {r["classification"] for r in batch.collect()} >= {"multi_stage_scam"}
    counts = arrivals.late_counts(spark, root).agg(F.sum("n_rows").alias("n"), F.sum("n_late").alias("late")).first()
    assert (counts["n"], counts["late"]) == (len(rows) + 4, 2)
    side = arrivals.committed(spark, f"{root}/arrived", arrivals.arrived_schema(live.ARTEFACT)).where("late")
    assert {r["item_id"] for r in side.collect()} == {"late1", "late2"}


def test_a_crash_in_the_middle_of_a_batch_changes_nothing(spark, tmp_path, monkeypatch):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = _artefacts()[:24] + [("u1", "bad", START, "fax", "x"), ("u1", "blank", START, None, " ")]
    whole, fail = arrivals.commit, {"left": 1}

    def breaking(df, path, number):
        if path.endswith("/errors") and number == 1 and fail["left"]:
            fail["left"] -= 1
            raise OSError("lost")
        return whole(df, path, number)

    monkeypatch.setattr(live, "commit", breaking)
    _put(spark, rows[:10], source)
    live.score_artefacts(_stream(spark, source), root, f"{root}/_s").awaitTermination()
    _put(spark, rows[10:], source)
    with pytest.raises(Exception, match="lost"):
        live.score_artefacts(_stream(spark, source), root, f"{root}/_s").awaitTermination()
    assert arrivals.is_committed(spark, f"{root}/verdicts", 1) and not arrivals.is_committed(spark, f"{root}/errors", 1)
    live.score_artefacts(_stream(spark, source), root, f"{root}/_s").awaitTermination()
    live.score_artefacts(_stream(spark, source), root, f"{root}/_s").awaitTermination()
    streamed = arrivals.committed(spark, f"{root}/verdicts", live.VERDICT).unionByName(arrivals.committed(spark, f"{root}/errors", live.VERDICT))
    table = spark.createDataFrame(rows, live.ARTEFACT).select(F.struct("user_id", "item_id", "ts").alias("item_id"), "type", "content")
    columns = ["item_id", "kind", "status", "risk_score", "scam_type", "indicators"]
    assert _plain(streamed, *columns) == _plain(verdicts.verdicts(table), *columns)
    assert arrivals.committed(spark, f"{root}/errors", live.VERDICT).count() == 2


def test_a_committed_batch_stays_as_it_is(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert arrivals.commit(spark.range(3).selectExpr("id"), path, 0) and not arrivals.commit(spark.range(9).selectExpr("id"), path, 0)
    spark.range(5).write.parquet(f"{path}/_batch-000000001")  # left by a crash before the rename
    schema = spark.range(1).schema
    assert arrivals.committed(spark, path, schema).count() == 3
    assert arrivals.commit(spark.range(2).selectExpr("id"), path, 1) and arrivals.committed(spark, path, schema).count() == 5
    assert arrivals.committed(spark, f"{tmp_path}/nothing", schema).count() == 0


def test_sliding_windows_with_late_rows(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = _artefacts()
    early, later = [r for r in rows if r[2] < START + dt.timedelta(hours=5)], [r for r in rows if r[2] >= START + dt.timedelta(hours=5)]
    late = [("u3", "late", START + dt.timedelta(minutes=1), "url", TEXTS["url"])]
    end = [("end", "z", START + dt.timedelta(days=3), "url", "a.example")]
    for part in (early[::2], early[1::2], later, late + end):
        _put(spark, part, source)
        arrivals.accept(_stream(spark, source), root, f"{root}/_a", delay="6 hours").awaitTermination()
        live.score_artefacts(arrivals.on_time(spark, root, live.ARTEFACT), root, f"{root}/_s").awaitTermination()
        live.count_levels(live.verdict_stream(spark, root), root, f"{root}/_l", "10 minutes", "5 minutes", "6 hours").awaitTermination()
    assert arrivals.late_counts(spark, root).agg(F.sum("n_late")).first()[0] == 1
    table = verdicts.verdicts(spark.createDataFrame(rows, live.ARTEFACT).select(F.struct("user_id", "item_id", "ts").alias("item_id"), "type", "content"))
    want = table.groupBy(F.window("item_id.ts", "10 minutes", "5 minutes").alias("w"), "kind", "risk_level").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "kind", "risk_level", "n")
    columns = ["start", "end", "kind", "risk_level", "n"]
    assert _plain(arrivals.committed(spark, f"{root}/levels", live.LEVELS), *columns) == _plain(want, *columns)
