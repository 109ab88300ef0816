"""The record log's two-phase commit, the polled stream over failures, and identity resolution against a replay."""

import http.server
import json
import random
import threading
from collections import Counter
from pathlib import Path

import pytest
from palisade.operators import identity
from palisade.sources.log import RecordLog
from palisade.sources.polling import PolledRecords
from pyspark.sql import functions as F

LOG = "seq bigint, auc double, note string"


def records(spark, first, last):
    return spark.range(first, last, numPartitions=3).select(F.col("id").alias("seq"), (F.col("id") / 10).alias("auc"), F.lit("x").alias("extra"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("n"), "id")).alias("note"))


def test_log_append_delete_tail(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"), LOG, "seq")
    assert log.rows().count() == 0 and log.tail(3).collect() == [] and log.delete(spark.range(3), "seq") == 0
    for k in range(4):
        log.append(records(spark, k * 30, k * 30 + 30))
    log.append(records(spark, 0, 0))  # nothing
    log.append(spark.createDataFrame([(None, None, None), (7, 0.7, "again")], LOG))
    want = Counter((r.seq, r.auc, r.note) for k in (range(120),) for r in records(spark, 0, 120).collect()) + Counter([(None, None, None), (7, 0.7, "again")])
    plain = lambda: Counter(tuple(r) for r in log.rows().collect())
    assert plain() == want
    before = {f["file"] for f in log.files()[1]}
    touched = log.delete(spark.createDataFrame([(7,), (95,), (95,), (4444,)], "id bigint"), "seq")
    after = {f["file"] for f in log.files()[1]}
    assert touched == 3 and len(before & after) == len(before) - 3
    for row in [r for r in want if r[0] in (7, 95)]:
        del want[row]
    assert plain() == want
    newest = sorted((r[0] for r in want if r[0] is not None), reverse=True)
    for n in (1, 5, 40, 500):
        assert [r.seq for r in log.tail(n).collect() if r.seq is not None] == newest[:n]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"), LOG, "seq")
    log.append(records(spark, 0, 10))

    @F.udf("double")
    def breaks(x):
        if x == 55:
            raise ValueError("broken record")
        return float(x)

    with pytest.raises(Exception, match="broken record"):
        log.append(records(spark, 50, 60).withColumn("auc", breaks("seq")))
    assert log.rows().count() == 10 and log.files()[0] == 1
    with pytest.raises(Exception, match="another change"):
        log.append(records(spark, 0, 5), version=0)
    assert log.rows().count() == 10
    live = {f["file"] for f in log.files()[1]}
    kept = {p.name for p in Path(tmp_path / "log" / "data").glob("*.parquet")}
    assert live <= kept and len(kept - live) <= 3  # of tasks that were stopped: in no manifest


class Service:
    """A paged service over a growing list, that fails a few times."""

    def __init__(self):
        outer = self
        self.rows, self.fail = [], 0

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                if outer.fail > 0:
                    outer.fail -= 1
                    self.send_error(500)
                    return
                query = dict(x.split("=") for x in self.path.partition("?")[2].split("&") if x)
                body = {"count": len(outer.rows)} if "from" not in query else outer.rows[int(query["from"]) : int(query["to"])]
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *a):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/records"


def test_polled_stream_over_failures(spark, tmp_path):
    service = Service()
    spark.dataSource.register(PolledRecords)
    options = {"count_url": service.url, "url": service.url + "?from={from}&to={to}", "page": "7", "most": "25", "wait": "0.01"}
    out, state, broken = str(tmp_path / "out"), str(tmp_path / "state"), []

    def put(batch, number):
        if broken and number >= 1:
            batch.count()
            raise RuntimeError("stopped between batches")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run():
        stream = spark.readStream.format("polled_records").schema("seq bigint, name string, tags string").options(**options).load()
        query = stream.writeStream.option("checkpointLocation", state).foreachBatch(put).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    service.rows = [{"seq": i, "name": f"n{i}", "tags": ["a", i]} for i in range(60)]
    service.fail = 2  # tried again
    broken.append(1)
    with pytest.raises(Exception, match="stopped between batches"):
        run()
    broken.clear()
    service.rows += [{"seq": i, "name": None} for i in range(60, 83)]  # more comes before the failed batch runs again
    run()
    service.rows += [{"seq": i, "name": "late"} for i in range(83, 90)]
    run()
    got = spark.read.schema("seq bigint, name string, tags string").parquet(f"{out}/batch=*").collect()
    assert Counter((r.seq, r.name, r.tags) for r in got) == Counter((r["seq"], r["name"], json.dumps(r["tags"]) if "tags" in r else None) for r in service.rows)
    service.server.shutdown()


PEOPLE = "person_id bigint, ext_id bigint, name string, birth_date string, draft_year int, position string"
RECORDS = PEOPLE.replace("person_id", "seq")


def replay(people, rows):
    """Every record against all people, in order."""
    persons = [dict(zip(("person_id", "ext_id", "name", "birth_date", "draft_year", "position"), p, strict=True)) for p in sorted(people, key=lambda p: p[0])]
    out = []
    for seq, ext, name, birth, year, position in sorted(rows, key=lambda r: r[0]):
        name = name or None
        found, how = next((p for p in persons if ext is not None and p["ext_id"] == ext), None), "id"
        if found is None and name:
            able = [p for p in persons if p["name"] == name and (birth is None or p["birth_date"] == birth)]
            able.sort(key=lambda p: (p["draft_year"] is None, -(p["draft_year"] or 0), p["person_id"] < 0, abs(p["person_id"])))
            found, how = (able[0] if able else None), "name"
        if found is None:
            how = "new"
            found = {"person_id": -1 - seq, "ext_id": ext, "name": name, "birth_date": birth, "draft_year": year, "position": position or "F"}
            persons.append(found)
        else:
            found["name"] = name or found["name"]
            found["position"] = position or found["position"]
            for k, v in (("ext_id", ext), ("birth_date", birth), ("draft_year", year)):
                found[k] = found[k] if found[k] is not None else v
        out.append((seq, found["person_id"], how))
    return out, persons


@pytest.mark.parametrize("seed", [1, 2])
def test_identity(spark, seed):
    rng = random.Random(seed)
    pick = lambda values: rng.choice(values)
    some = lambda n: (pick([None, *range(40)]), pick([None, "", *[f"name {i}" for i in range(25)]]), pick([None, None, "2001-02-03", "2002-03-04"]), pick([None, 2019, 2020, 2021]), pick([None, "C", "D"]))
    people, seen = [], set()
    for i in range(30):
        ext, name, *rest = some(0)
        if ext in seen:
            ext = None
        seen.add(ext)
        people.append((i, ext, name or f"only {i}", *rest))
    rows = [(i, *some(0)) for i in range(150)] + [(200 + i, None, None, None, None, None) for i in range(3)]
    wanted, persons = replay(people, rows)
    matches, after = identity.resolve(spark.createDataFrame(people, PEOPLE).repartition(3), spark.createDataFrame(rows, RECORDS).withColumn("root", F.lit("clash")).repartition(4))
    assert Counter(map(tuple, matches.collect())) == Counter(wanted)
    assert Counter((r.person_id, r.ext_id, r.name, r.birth_date, r.draft_year, r.position) for r in after.collect()) == Counter(tuple(p[k] for k in ("person_id", "ext_id", "name", "birth_date", "draft_year", "position")) for p in persons)
    assert {h for *_, h in wanted} == {"id", "name", "new"}


def test_identity_of_nothing(spark):
    none = identity.resolve(spark.createDataFrame([], PEOPLE), spark.createDataFrame([], RECORDS))
    assert [x.collect() for x in none] == [[], []]


def test_components_of_a_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1002, 1002), (1001, 1000)]
    found = {r.node: r.root for r in identity.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000, 1002: 1002}
