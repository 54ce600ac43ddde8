import json

from tidewright.plans import onboarding as ob
from tidewright.streaming.landing import land_pages


def test_stream_lands_each_page_once(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    ws = ob.Workspace(spark, str(tmp_path / "state"))

    def drop(n, items):
        document = {"items": items, "page": n, "page_size": 2, "total": 3, "has_next": False}
        (folder / f"p{n}.json").write_text(json.dumps(document))

    def run():
        land_pages(spark, ws, str(folder), "t", "s", str(tmp_path / "ckpt")).awaitTermination(120)

    drop(1, [{"CustID": "a"}, {"CustID": "b"}])
    run()
    drop(2, [{"CustID": "c"}])
    run()
    run()
    assert ws.read("batches").count() == 2 and ws.read("sources").count() == 1
    rows = ws.raw().orderBy("row_index").collect()
    assert [(r.row_index, r.raw["CustID"]) for r in rows] == [(0, "a"), (1, "b"), (2, "c")]
