"""Who a record is about: matching by an outside id, else by name and birth date, as records come one after the other.

A record may create the person that a later one of the same batch matches, so matching is a replay in order. Only records that share
an id or a name, directly or through others, can touch each other: they are found as connected components of keys, and each component is
replayed by itself, with the few columns that matching needs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of ``edges`` (a, b; longs) with the least node that it can reach; written table by table.

    Each round hands a node the least label of its neighbours and then follows labels once more (a label is a node), so long chains take about
    log n rounds. A hub is one key of an aggregate, summed up before it is shuffled.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "identity-edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "identity-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        joined = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "least").alias("new"))
        # the old label of a node learns of the new one too, so that whole trees move
        told = joined.where("new < label").groupBy(F.col("label").alias("node")).agg(F.min("new").alias("told"))
        moved = joined.join(told, "node", "left").select("node", "label", F.least("new", "told").alias("new"))
        jump = moved.select(F.col("node").alias("_at"), F.col("new").alias("_next"))
        after = written(moved.join(jump, F.col("new") == F.col("_at"), "left").select("node", "label", F.least("new", "_next").alias("new")), "identity-labels")
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "root")


#: What a person keeps: the first value that is known, but for name and position, where a new one replaces the old.
KEPT = ("birth_date", "draft_year")


def resolve(people: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, people after): records matched in order of ``seq``, one after the other.

    ``people``: person_id, ext_id, name, birth_date, draft_year, position. ``records``: seq and the same without person_id. A record is about the
    person of its ext_id; else, if it has a name, the person of that name (and of the birth date, if it has one) with the newest draft
    year, nulls last, of equals the lowest person_id; else a new person, whose person_id is -1 - seq. A match fills what the person lacks, and the name
    and position replace those there. Equal ids or seqs within a table: the first in the order of their columns. Records without id and name
    always make a new person. ``matches``: seq, person_id, how (id, name, new).
    """
    columns = ("ext_id", "name", "birth_date", "draft_year", "position")
    empty = F.lit(None)
    rows = people.select("person_id", empty.cast("bigint").alias("seq"), *columns).unionByName(records.select(empty.cast("bigint").alias("person_id"), "seq", *columns))
    rows = rows.withColumns({"birth_date": F.col("birth_date").cast("string"), "draft_year": F.col("draft_year").cast("int"), "ext_id": F.col("ext_id").cast("bigint"), "name": F.when(F.col("name") != "", F.col("name"))})
    rows = written(rows, "identity-rows")
    own = F.when(F.col("person_id").isNotNull(), F.xxhash64(F.lit("p"), "person_id")).otherwise(F.xxhash64(F.lit("r"), "seq"))
    keys = F.array_compact(F.array(own, F.when(F.col("ext_id").isNotNull(), F.xxhash64(F.lit("i"), "ext_id")), F.when(F.col("name").isNotNull(), F.xxhash64(F.lit("n"), "name"))))
    roots = components(rows.select(own.alias("a"), F.explode(keys).alias("b")))  # hashes that collide only join components
    placed = rows.withColumn("_own", own).join(roots, F.col("_own") == F.col("node")).drop("_own", "node")

    def replay(table: pa.Table) -> pa.Table:
        everyone = sorted(table.to_pylist(), key=lambda r: (r["person_id"] is None, r["person_id"] if r["person_id"] is not None else r["seq"] if r["seq"] is not None else 1 << 62, *(str(r[c]) for c in columns)))
        persons, by_id, by_name, out = [], {}, {}, []

        def put(person):
            if person["ext_id"] is not None:
                by_id.setdefault(person["ext_id"], person)
            if person["name"] is not None:
                by_name.setdefault(person["name"], []).append(person)

        for row in everyone:
            if row["person_id"] is not None:
                persons.append({k: row[k] for k in ("person_id", *columns)})
                put(persons[-1])
                continue
            found, how = by_id.get(row["ext_id"]) if row["ext_id"] is not None else None, "id"
            if found is None and row["name"] is not None:
                able = [p for p in by_name.get(row["name"], []) if row["birth_date"] is None or p["birth_date"] == row["birth_date"]]
                if able:
                    found, how = min(able, key=lambda p: (p["draft_year"] is None, -(p["draft_year"] or 0), p["person_id"] < 0, abs(p["person_id"]))), "name"
            if found is None:
                how, found = "new", {"person_id": -1 - (row["seq"] if row["seq"] is not None else 1 << 62), **{k: row[k] for k in columns}}
                found["position"] = found["position"] or "F"
                persons.append(found)
                put(found)
            else:
                if row["name"] is not None and row["name"] != found["name"]:
                    if found["name"] is not None:
                        by_name[found["name"]] = [p for p in by_name[found["name"]] if p is not found]
                    found["name"] = row["name"]
                    by_name.setdefault(row["name"], []).append(found)
                if found["ext_id"] is None and row["ext_id"] is not None:
                    found["ext_id"] = row["ext_id"]
                    by_id.setdefault(row["ext_id"], found)
                found["position"] = row["position"] or found["position"]
                for k in KEPT:
                    found[k] = found[k] if found[k] is not None else row[k]
            out.append({"seq": row["seq"], "person_id": found["person_id"], "how": how, **dict.fromkeys(columns)})
        out += [{"seq": None, "how": None, **p} for p in persons]
        return pa.Table.from_pylist(out, schema=schema)

    text = ("name", "birth_date", "position", "how")
    names = ["seq", "person_id", "how", *columns]
    schema = pa.schema([(n, pa.string() if n in text else pa.int32() if n == "draft_year" else pa.int64()) for n in names])
    ddl = ", ".join(f"{n} {'string' if n in text else 'int' if n == 'draft_year' else 'bigint'}" for n in names)
    done = written(placed.groupBy("root").applyInArrow(lambda t: replay(t.drop_columns(["root"])), ddl), "identity-done")
    matches = done.where("how IS NOT NULL").select("seq", "person_id", "how")
    return matches, done.where("how IS NULL").select("person_id", *columns)
