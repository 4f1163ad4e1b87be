"""Headline benchmark: prints ONE JSON line.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]:
  ingest      entries -> redacted -> inverted index written as Parquet
  search100   a batch of 100 ranked searches (one plan) over the written index
  find        the staged find (exact / OR / LIKE) for 10 queries
  redact      redaction sweep over all document text
  refresh     fingerprint diff of a second refresh against the stored entries
  consolidate memory decay over the events-derived memory table
  transcripts conversations rendered as JSONL, parsed into turns
  scan        transcript files listed, read by ranges, parsed into turns
  rescan      the same files again, none changed: listed, none opened
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from knowspark.operators import index as ix  # noqa: E402
from knowspark.operators import memory as M  # noqa: E402
from knowspark.operators import redact as R  # noqa: E402
from knowspark.operators import refresh as RF  # noqa: E402
from knowspark.operators import search as S  # noqa: E402
from knowspark.plans import store_queries as SQ  # noqa: E402
from knowspark.plans import transcript_queries as TQ  # noqa: E402
from knowspark.plans import views as V  # noqa: E402
from knowspark.session import local_session, scratch_path  # noqa: E402
from knowspark.sources import files as FI  # noqa: E402
from knowspark.sources import transcripts as TR  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16))
    times = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # warm-up: JVM, parquet footers (not timed)
    run(V.entries(spark, sf).select("id"))

    path = scratch_path(spark, "bench-index")

    def ingest():
        e = R.redact(V.entries(spark, sf), "content", "redacted").drop("redacted")
        ix.write_index_from(e, path)
    timed("ingest", ingest)
    idx = ix.read_index(spark, path)

    # 100 query strings: frequent, medium and rare terms, pairs (parameters of the run)
    terms = [r[0] for r in idx.postings.filter("size(pos_content) > 0").groupBy("term").count()
             .filter(F.col("count") >= 3).orderBy(F.desc("count"), "term").limit(400).collect()]
    qs = {}
    for i in range(100):
        a, b = terms[(i * 7) % len(terms)], terms[(i * 13 + 5) % len(terms)]
        qs[i] = a if i % 3 == 0 else (f"{a} {b}" if i % 3 == 1 else f'"{a} {b}" OR {a}')
    timed("search100", lambda: run(S.evaluate(idx, {q: S.parse_match(t) for q, t in qs.items()})))
    fq = {i: qs[i] for i in range(10)}
    fq[10] = "zzqx aux."
    timed("find", lambda: run(S.find(idx, fq, limit=20)))

    docs = V.table(spark, sf, "documents")
    timed("redact", lambda: run(R.redact(docs.select("doc_id", "text"), "text", "fams")))
    timed("refresh", lambda: run(RF.refresh_diff(SQ._items(spark, sf), SQ._stored(spark, sf))))
    timed("consolidate", lambda: run(M.consolidate(V.memory_entries(spark, sf), "2024-06-01 12:00:00")))
    timed("transcripts", lambda: run(TR.turns(TQ._render(spark, sf, "claude_code"), "t", "claude_code")))

    # transcript files: a first scan, and a second one that finds nothing new
    out = scratch_path(spark, "bench-sessions")
    TQ._render(spark, sf, "codex").repartition(64, "stem").sortWithinPartitions("stem", "line_no").select("value").write.text(out)
    state = spark.createDataFrame([], FI.STATE)

    def scan(state):
        items, new = FI.scan_transcripts(FI.listing(spark, out.replace("file:", "", 1), ["*.txt"]), state, "sessions", "codex")
        run(items)
        return new
    new = timed("scan", lambda: scan(state))
    new.write.parquet(out + "-state")
    timed("rescan", lambda: scan(spark.read.parquet(out + "-state")))

    n_entries = V.entries(spark, sf).count()
    mb = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] / 1e6
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus, "entries": n_entries,
                      "ingest_entries_per_sec": round(n_entries / max(times["ingest"], 1e-9), 1),
                      "redact_mb_per_sec": round(mb / max(times["redact"], 1e-9), 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
