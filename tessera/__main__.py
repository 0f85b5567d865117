"""python -m tessera sql DIR QUERY | tables DIR | seed ROOT N | run ROOT SPECS PORT

SQL over a folder of Parquet tables; a seeded store; the HTTP service of declared tables (SPECS is a JSON file)."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    if not args or len(args) != {"sql": 3, "tables": 2, "seed": 3, "run": 4}.get(args[0]):
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args[0] == "seed":
        from . import workload
        from .sources.kv import KvStore

        seq = KvStore(spark, args[1]).put_frame(workload.entries(spark, int(args[2])).select("key", "value"))
        print(f"{args[2]} entries in batch {seq}")
        return 0
    if args[0] == "run":
        import threading

        from .service import serve, specs_of
        from .session import Engine

        engine = Engine(spark, args[1])
        with open(args[2]) as f:
            for spec in specs_of(f.read()):
                engine.register(spec)
        print(f"http://127.0.0.1:{serve(engine, int(args[3])).server_port}", flush=True)
        threading.Event().wait()
    from .sources.log import Store

    names = [n.removesuffix(".parquet") for n in Store(spark, args[1]).names("") if n.endswith(".parquet")]
    for n in names:
        spark.read.parquet(f"{args[1]}/{n}.parquet").createOrReplaceTempView(n)
    if args[0] == "tables":
        for n in sorted(names):
            print(n, spark.table(n).schema.simpleString())
    else:
        spark.sql(args[2]).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
