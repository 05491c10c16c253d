"""Listing pages of a stream, taken until the first empty or repeated one; restarts go on where the stream was."""

from rankframe.session import scratch_path
from rankframe.streaming.listing_stream import pages_until_repeat_stream, rocksdb_state

KIND = "page_id long, start long, html string, site string"
ROW = ('<tr data-entity-id="{i}"><td class="custom__table-heading__title"><a href="/v/{i}/">{i}</a></td><td></td><td></td>'
       '<td class="custom__table-heading__general product-catalogue__keys"></td></tr>')


def page(site, n, ids):
    return (n, 1 + 12 * n, "<table>" + "".join(ROW.format(i=i) for i in ids) + "</table>", site)


def listing(site, lists):
    return [page(site, n, ids) for n, ids in enumerate(lists)]


def taken(lists):
    """(start, id) by the plain loop."""
    seen, out = set(), []
    for n, ids in enumerate(lists):
        if not ids or tuple(ids) in seen:
            break
        seen.add(tuple(ids))
        out += [(1 + 12 * n, i) for i in ids]
    return out


def run(spark, folder, sink, ck):
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)
    with rocksdb_state(spark):
        q = (pages_until_repeat_stream(stream, "https://x.example", "site").writeStream.format("parquet")
             .option("path", sink).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
    return q


def test_each_listing_stops_at_its_first_repeat_also_after_a_restart(spark):
    sites = {"a": [["1", "2"], ["3"], ["1", "2"], ["4"]],           # repeats its first page
             "b": [["5"], ["6", "7"], [], ["8"]],                   # an empty page
             "c": [["9"], ["2", "1"], ["1", "2"], ["10"], ["9"]],   # other order is another page
             None: [["11"], ["12"]]}                                # never ends
    pages = [p for s, lists in sites.items() for p in listing(s, lists)]
    folder, sink, ck = (scratch_path(spark, n) for n in ("t-land", "t-sink", "t-ck"))
    # out of order, and in two runs of the stream: odd pages before the even ones
    late = [p for p in pages if p[0] % 2 == 0]
    spark.createDataFrame([p for p in pages if p[0] % 2], KIND).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, sink, ck)
    assert spark.read.parquet(sink).count() == 0  # all wait for their first page
    for part in (late[len(late) // 2:], late[:len(late) // 2], late):  # the last one repeats what has come already
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(folder)
        q = run(spark, folder, sink, ck)
    got = {}
    for r in spark.read.parquet(sink).orderBy("start", "row_pos").collect():
        got.setdefault(r.listing, []).append((r.start, r.assessment_id))
    assert got == {s or "": taken(lists) for s, lists in sites.items()}
    # an ended listing keeps its flag alone; the open one its place and two signatures
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 + 3 + 2


def test_registered_query_is_the_batch_operator(spark):
    import __spark_entry__ as E
    from conftest import SMALL
    q = E.queries()
    assert sorted(q["pages_stream_until_repeat"](spark, SMALL).collect()) == sorted(q["pages_until_repeat"](spark, SMALL).collect())
