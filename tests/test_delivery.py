import datetime as dt
import hashlib
import json

import pytest

from pyspark.sql import functions as F

from tidemark.operators import messages
from tidemark.operators.digests import list_digests
from tidemark.session import shared_folder
from tidemark.sources.channel import ChannelWriter, outcomes
from tidemark.streaming.delivery import deliver_alerts

D = dt.date.fromisoformat
FILING = "cik string, accession string"


def arrive(spark, path, *rows):
    spark.createDataFrame(list(rows), FILING).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(FILING).parquet(path)


def book(tmp_path, down=()):
    """A send function that notes what it was given, and the notes."""
    path = str(tmp_path / "sent")

    def send(message):
        with open(path, "a") as out:
            out.write(json.dumps([message["subscription_id"], message["accession"], message["body"]]) + "\n")
        if message["accession"] in down:
            raise ConnectionError(f"{message['accession']} is down")

    return send, lambda: sorted(tuple(json.loads(x)[:2]) for x in open(path)) if (tmp_path / "sent").exists() else []


def tables(spark, newest):
    subs = spark.createDataFrame([("s1", "1", "email", "a@b", True), ("s2", "1", "email", "c@d", False), ("s3", "2", "hook", "x", True), ("s4", "1", "email", "e@f", True)],
                                 "subscription_id string, cik string, channel string, target string, active boolean")
    text = spark.createDataFrame([(c, a, f"about {a}", f"body of {a}") for c, a in newest], "cik string, accession string, subject string, body string")
    return subs, text


def statuses(df):
    return {(r.subscription_id, r.accession): (r.status, r.attempts) for r in df.collect()}


def test_failed_deliveries_come_again_and_replaced_filings_do_not(spark, tmp_path):
    path, source = shared_folder(spark, "channel"), str(tmp_path / "filings")
    send, sent = book(tmp_path, down={"a", "x"})
    primed = spark.createDataFrame([("s4", "a")], "subscription_id string, accession string")
    out = deliver_alerts(arrive(spark, source, ("1", "a"), ("2", "x"), ("1", "old")), *tables(spark, [("1", "a"), ("2", "x")]), send, path, primed)
    assert statuses(out) == {("s1", "a"): ("failed", 1), ("s3", "x"): ("failed", 1)} and out.where("subscription_id = 's1'").first().error == "a is down"

    send, sent = book(tmp_path)
    out = deliver_alerts(arrive(spark, source, ("1", "b")), *tables(spark, [("1", "b"), ("2", "x")]), send, path, primed)
    assert statuses(out) == {("s1", "a"): ("failed", 1), ("s3", "x"): ("sent", 2), ("s1", "b"): ("sent", 1), ("s4", "b"): ("sent", 1)}
    before = sent()
    assert statuses(deliver_alerts(arrive(spark, source, ("1", "b")), *tables(spark, [("1", "b"), ("2", "x")]), send, path, primed)) == statuses(out)
    assert sent() == before and before.count(("s3", "x")) == 2


def test_a_run_that_stops_before_its_commit_sends_nothing_twice(spark, tmp_path):
    class Stops(ChannelWriter):
        """Loses the driver between write and commit."""

        def commit(self, messages, batchId):
            raise RuntimeError("driver lost")

    path, source = shared_folder(spark, "channel"), str(tmp_path / "filings")
    send, sent = book(tmp_path, down={"x"})
    rows = [("1", "a"), ("2", "x")]
    with pytest.raises(Exception, match="driver lost"):
        deliver_alerts(arrive(spark, source, *rows), *tables(spark, rows), send, path, writer=Stops)
    assert sent() == [("s1", "a"), ("s3", "x"), ("s4", "a")] and outcomes(spark, path).count() == 0
    out = deliver_alerts(spark.readStream.schema(FILING).parquet(source), *tables(spark, rows), book(tmp_path)[0], path)
    assert statuses(out)["s1", "a"] == ("sent", 1) and statuses(out)["s3", "x"][0] == "sent"
    assert [x for x in sent() if x != ("s3", "x")] == [("s1", "a"), ("s4", "a")] and ("s3", "x") in sent()


def test_text_of_a_filing(spark):
    filings = spark.createDataFrame([("0000000007", "07-24-1", "13F-HR/A", D("2024-08-14"), D("2024-06-30"), D("2024-03-31")), ("0000000008", "08-24-1", "13F-HR", D("2024-08-14"), D("2024-06-30"), None)],
                                    "cik string, accession string, form string, filing_date date, report_date date, prev_report_date date")
    m = [("NEW", "NVDA", "NVIDIA", "", 0.0, 2.5e9, None), ("NEW", "", "SMALL", "Put", 0.0, 900.0, None), ("EXIT", "KO", "COCA", "", 3.4e6, 0.0, None),
         ("ADD", "AAPL", "APPLE", "", 1e3, 2e3, 0.455), ("TRIM", None, "GE", "", 5e3, 1e3, -0.8), ("HOLD", "T", "ATT", "", 1.0, 1.0, 0.0)]
    moves = spark.createDataFrame([("0000000007", D("2024-06-30"), f"c{i}", *x) for i, x in enumerate(m)],
                                  "cik string, report_date date, cusip string, move string, ticker string, issuer string, put_call string, prev_value double, curr_value double, share_change_pct double")
    funds = spark.createDataFrame([("0000000007", "Oak", "Jane Roe"), ("0000000008", "Elm", None)], "cik string, label string, manager string")
    got = {r.cik[-1]: r for r in messages.filing_messages(filings, moves, funds, 1, "[Alert] ").collect()}
    assert got["7"].body == "\n".join([
        "[Alert] Oak 13F (amendment) (2024-06-30): 2 new, 1 exits", "", "Oak — Jane Roe", "Quarter 2024-06-30 vs 2024-03-31 | filed 2024-08-14 | 13F-HR/A", "",
        "New:", "  - NVDA NVIDIA: NEW $2.5B", "", "Exited:", "  - KO COCA: EXIT $3.4M", "", "Added:", "  - AAPL APPLE: +46% shares", "", "Trimmed:", "  - GE: -80% shares", "",
        "https://www.sec.gov/Archives/edgar/data/7/07241/"])
    assert got["8"].body == "\n".join(["[Alert] Elm 13F (2024-06-30): filing update", "", "Quarter 2024-06-30 (first filing on record) | filed 2024-08-14 | 13F-HR", "",
                                       "https://www.sec.gov/Archives/edgar/data/8/08241/"])


def test_digest_of_a_list_needs_no_list(spark):
    odd = ["b", "a", "a", 'say "x"\\', "é\n", "", None, "\x01"]
    rows = spark.createDataFrame([("k", x) for x in odd] + [(None, "z"), (None, "y"), ("only null", None)], "k string, x string").repartition(3)
    want = {k: (len(v), hashlib.sha256(spark.range(1).select(F.to_json(F.array(*map(F.lit, v)))).first()[0].encode()).hexdigest(), ";".join(v))
            for k, v in (("k", sorted({x for x in odd if x is not None}, key=lambda x: x.encode())), (None, ["y", "z"]))}
    got = {r.k: tuple(r)[1:] for r in list_digests(rows, ["k"], "x", texts={"joined": "x"}).collect()}
    assert got == want
    twice = list_digests(rows.where("k = 'k'"), ["k"], F.lit("e"), ["x"], distinct=False, texts={"joined": "x"}).first()
    assert twice.n == 8 and twice.digest == hashlib.sha256(("[" + ",".join(['"e"'] * 8) + "]").encode()).hexdigest()
    assert list_digests(rows.limit(0), ["k"], "x").count() == 0


def test_digest_of_a_million_entries_under_one_key(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select(F.lit(1).alias("k"), F.format_string("%07d", F.lit(n - 1) - F.col("id")).alias("x")).unionByName(
        spark.createDataFrame([(2, "x")], "k int, x string"))
    got = {r.k: (r.n, r.digest) for r in list_digests(rows, ["k"], "x").collect()}
    assert got[1] == (n, hashlib.sha256(("[" + ",".join(f'"{i:07d}"' for i in range(n)) + "]").encode()).hexdigest()) and got[2][0] == 1
