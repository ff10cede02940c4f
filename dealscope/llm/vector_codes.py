"""Vector code compression: product quantisation by member-resident Lloyd rounds in integers.

Vectors become integers floor(SCALE * x) and are cut into PARTS equal parts. A row per part lives with its owner, the partition of its
(position, entry, salt); an entry has as many salts as its share of all parts asks for, so no owner holds more than
about 1 / OWNERS of them. A round reads every owner's residents where they are: those whose nearest entry is still
their own stay, and only those that change entry go through the shuffle to their new owner. Sums and counts of an entry are kept as exact
integers: owners add up their residents once, at the first deal, later rounds add what arrives and take off what
leaves. Only these 8 x 16 sums and the codebooks, whose size does not depend on the rows, meet on the driver.
Residents and movers are tables in the shared folder, so a lost executor costs the reading of one round.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped, and so are those that cannot be cut like the
vector of the smallest vec_id (its length, a multiple of PARTS); a null vec_id is encoded but gives no first entry; rows that repeat a vec_id
are each encoded, and give one first entry, the smallest vector; fewer than ENTRIES vec_ids give as many entries;
equal distances go to the lower index; null labels form one group; extra columns are ignored; an empty table gives no rows. Squared distances are exact in a
long while components stay under 2 ** 14; a vector that goes beyond raises an ArithmeticError rather than give a wrapped number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import drop, stored, table

PARTS, ENTRIES, ROUNDS, SCALE, OWNERS, RESIDENTS = 8, 16, 6, 4096, 1024, 1 << 17
LARGEST = 1 << 26
STATE = "id long, vec_id long, label int, position int, entry int, x array<int>"


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower) and its squared distance, block by block."""
    entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), 8192):
        d = ((x[at : at + 8192, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        entry[at : at + 8192] = d.argmin(axis=1)
        error[at : at + 8192] = d.min(axis=1)
    return entry, error


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _cut(batches):
    """A row per vector and part, with the integers that belong to it."""
    for b in batches:
        if not b.num_rows:
            continue
        x = np.floor(SCALE * b.column(3).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1))
        if np.abs(x).max() > LARGEST:
            raise ArithmeticError("components of 2 ** 14 or more leave the exact range of squared distances")
        x = x.astype(np.int32).reshape(b.num_rows * PARTS, -1)
        again = pa.array(np.repeat(np.arange(b.num_rows), PARTS))
        bounds = np.arange(len(x) + 1) * x.shape[1]
        position = np.tile(np.arange(PARTS, dtype=np.int32), b.num_rows)
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(again) for i in range(3)), pa.array(position), tk.lists(x.ravel(), bounds, pa.int32())], ["id", "vec_id", "label", "position", "x"])


def _assigned(books):
    """Residents with their nearest entry under the present codebooks, and its squared distance."""

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, position = _matrix(b.column("x")), b.column("position").to_numpy()
            entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p in np.unique(position):
                own = position == p
                entry[own], error[own] = _nearest(x[own], books.value[p])
            rest = [b.column(c) for c in ("id", "vec_id", "label", "position", "entry", "x")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(entry, pa.int32()), pa.array(error)], ["id", "vec_id", "label", "position", "entry", "x", "new", "error"])

    return work


def _sums(parts: DataFrame, entry: str) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(position, entry) -> count and sum of the parts' components, added up in the tasks; Python integers at the end."""

    def work(batches):
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, p, e = _matrix(b.column(2)), b.column(0).to_numpy(), b.column(1).to_numpy()
            key = p.astype(np.int64) * ENTRIES + e
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(tk.starts(key[order]))
            for k, s, n in zip(key[order][first].tolist(), np.add.reduceat(x[order], first, axis=0), np.diff(np.append(first, len(key)))):
                old = total.get(k)
                total[k] = [n, s] if old is None else [old[0] + n, old[1] + s]
        if total:
            yield pa.RecordBatch.from_pylist([{"position": k // ENTRIES, "entry": k % ENTRIES, "n": int(n), "s": s.tolist()} for k, (n, s) in total.items()])

    each = parts.select("position", F.col(entry).alias("entry"), "x").mapInArrow(work, "position long, entry long, n long, s array<long>")
    whole = each.select("position", "entry", "n", F.posexplode("s").alias("i", "v")).groupBy("position", "entry", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for r in whole.orderBy("i").collect():  # at most PARTS x ENTRIES x components of a part
        n, s = out.get((r["position"], r["entry"]), (r["n"], np.zeros(0, object)))
        out[r["position"], r["entry"]] = n, np.append(s, int(r["v"]))
    return out


def _dealt(parts: DataFrame, counts: dict[tuple[int, int], int]) -> DataFrame:
    """Shuffled to the owners: entries of many parts have many salts."""
    whole = max(1, sum(counts.values()))
    share = max(1, min(RESIDENTS, whole // OWNERS))
    salts = [-(-counts.get((p, e), 0) // share) or 1 for p in range(PARTS) for e in range(ENTRIES)]
    salt = F.pmod(F.xxhash64("id"), F.array(*(F.lit(s) for s in salts))[F.col("position") * ENTRIES + F.col("entry")])
    return parts.repartition("position", "entry", salt)


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("v is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    whole = rows.where(f"vec_id is not null and size(v) % {PARTS} = 0")
    seeds = whole.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(ENTRIES).collect()
    length = len(seeds[0]["v"]) if seeds else PARTS
    seeds = [r for r in seeds if len(r["v"]) == length]
    rows = stored(rows.where(F.size("v") == length).select(F.monotonically_increasing_id().alias("id"), "vec_id", "label", "v"))
    # without any vec_id there is nothing to start from: one entry of zeros
    first = np.floor(SCALE * np.array([r["v"] for r in seeds] or [[0.0] * length], np.float64)).astype(np.int64)
    books = [first[:, p * (length // PARTS) : (p + 1) * (length // PARTS)].copy() for p in range(PARTS)]

    def assigned(state: DataFrame) -> DataFrame:
        return state.mapInArrow(_assigned(spark.sparkContext.broadcast(books)), f"{STATE}, new int, error long")

    parts = rows.mapInArrow(_cut, "id long, vec_id long, label int, position int, x array<int>")
    start = stored(assigned(parts.withColumn("entry", F.lit(-1))))
    drop(rows)
    sums = _sums(start, "new")
    columns = [c.split()[0] for c in STATE.split(", ")]
    arrived = start.drop("entry", "error").withColumnRenamed("new", "entry").select(*columns)
    state = stored(_dealt(arrived, {k: n for k, (n, _) in sums.items()}))
    drop(start)
    held = [state]
    for r in range(rounds):
        books = [np.array([[int(v // sums[p, e][0]) for v in sums[p, e][1]] if sums.get((p, e), (0,))[0] else book.tolist() for e, book in enumerate(books[p])], np.int64) for p in range(PARTS)]
        if r == rounds - 1:
            break
        seen = stored(assigned(state))  # residents read where they are
        moved = seen.where("new <> entry")
        for column, sign in (("entry", -1), ("new", 1)):
            for k, (n, s) in _sums(moved, column).items():
                m, t = sums.get(k, (0, np.zeros(len(s), object)))
                sums[k] = m + sign * n, t + sign * s
        drop(*held)
        coming = stored(_dealt(moved.drop("entry", "error").withColumnRenamed("new", "entry").select(*columns), {k: n for k, (n, _) in sums.items()}))
        held = [seen, coming]
        state = seen.where("new = entry").select(*columns).union(coming)
    final = assigned(state)
    code = F.transform(F.sort_array(F.collect_list(F.struct("position", "new"))), lambda c: F.lpad(F.lower(F.hex(c["new"])), 2, "0"))
    coded = stored(final.groupBy("id", "vec_id", "label").agg(F.array_join(code, "").alias("code"), F.sum("error").alias("error")))
    drop(*held)
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book.tolist() for v in e).encode()).hexdigest()
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Every round as two common tables: assignment and codebooks."""
    sql = [
        "with k as materialized (select row_number() over () as id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        "p as materialized (select id, s.i as part, v[s.i * (len(v) // 8) + 1 : (s.i + 1) * (len(v) // 8)] as x from k, range(8) s(i))",
        "b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as e, x as c from p join k using (id) where vec_id in (select vec_id from k order by vec_id limit 16))",
    ]
    for r in range(ROUNDS + 1):
        sql.append(f"a{r} as materialized (select id, part, x, min(row(list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::bigint, e)) as best from p join b{r} using (part) group by id, part, x)")
        if r < ROUNDS:
            sql.append(f"""b{r + 1} as materialized (select part, e, coalesce(n.c, o.c) as c from b{r} o left join (
  select part, e, list((s - ((s % m) + m) % m) // m order by j) as c from (select part, best[2] as e, j, sum(x[j])::bigint as s, count(*) as m from a{r}, range(1, 9) t(j) where j <= len(x) group by all) group by part, e) n using (part, e))""")
    last = f"a{ROUNDS}"
    return ",\n".join(sql) + f""",
f as (select vec_id, label, string_agg(printf('%02x', best[2]::int), '' order by part) as code, sum(best[1])::bigint as error from {last} join k using (id) group by id, vec_id, label)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) from b{ROUNDS}) as codebooks_sha256 from f"""


ORACLE = _oracle()
