"""The HTTP service and the command line."""

import json
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from tessera.service import serve, specs_of
from tessera.session import Engine
from tessera.spec import SpecError

SPECS = json.dumps([{"name": "orders", "columns": [["id", "int64"], ["region", "utf8"], ["cents", "int64", True]], "primary_key": ["id"], "indexes": [{"name": "by_region", "keys": ["region"], "cover": ["cents"]}]}])


@pytest.fixture
def ask(spark, root):
    e = Engine(spark, root)
    for spec in specs_of(SPECS):
        e.register(spec)
    e.insert_sql("orders", "VALUES (1, 'eu', 250), (2, 'us', NULL)")
    e.insert_sql("orders", "VALUES (1, 'eu', 300), (3, 'eu', 5)")
    server = serve(e)

    def get(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urlopen(Request(f"http://127.0.0.1:{server.server_port}{path}", data), timeout=120) as r:
                assert r.headers["Access-Control-Allow-Origin"] == "*"
                return r.status, [json.loads(line) for line in r]
        except HTTPError as error:
            return error.code, [json.loads(line) for line in error]

    yield get
    server.shutdown()


def test_service(ask):
    assert ask("/health") == (200, [{"status": "ok", "seq": 2}])
    assert ask("/tables")[1][0]["primary_key"] == ["id"]
    query = "SELECT region, sum(cents) AS s FROM orders GROUP BY region ORDER BY region"
    assert ask("/query", {"sql": query}) == (200, [{"region": "eu", "s": 305}, {"region": "us", "s": None}])
    assert ask("/query", {"sql": query, "at": 1})[1][0] == {"region": "eu", "s": 250}
    assert ask("/query", {"sql": query}) == (200, [{"region": "eu", "s": 305}, {"region": "us", "s": None}])
    assert ask("/query", {"sql": "SELECT * FROM orders WHERE id = 9"}) == (200, [])
    status, (error,) = ask("/query", {"sql": query, "min_seq": 9})
    assert (status, error["code"]) == (409, "CONSISTENCY_NOT_READY")
    assert ask("/query", {"sql": "SELECT nothing FROM orders"})[0] == 400 and ask("/query", {"no": 1})[0] == 400
    assert ask("/other")[0] == ask("/other", {})[0] == 404
    status, frames = ask("/subscribe?table=orders&where=cents%20%3E%20100&since=1&once=1")
    assert status == 200 and [(f["seq"], [r["cents"] for r in f["rows"]]) for f in frames] == [(1, [250]), (2, [300])]
    assert ask("/subscribe?table=orders&where=nothing%20%3E%201&since=1&once=1")[0] == 400 and ask("/subscribe?table=none")[0] == 400


def test_declarations_are_checked():
    with pytest.raises(SpecError):
        specs_of('[{"name": "t", "columns": [["a", "map"]], "primary_key": ["a"]}]')


def test_command_line(spark, root, sf_dir, capsys):
    from tessera.__main__ import main
    from tessera.sources.kv import KvStore

    assert main([]) == main(["seed", "x"]) == main(["other", "x"]) == 2
    assert main(["seed", root, "50"]) == 0 and KvStore(spark, root).state().count() == 50
    assert main(["tables", sf_dir]) == 0 and main(["sql", sf_dir, "SELECT count(*) AS regions FROM region"]) == 0
    out = capsys.readouterr().out
    assert "50 entries in batch 1" in out and "r_regionkey" in out and "regions" in out
