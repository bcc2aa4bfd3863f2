import json

from colloquia.operators import runs as rn
from colloquia.sources.runs import read_runs


def put(root, path, value):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def analysis(total=80, included=60, summary="Said a lot"):
    return {"groupIds": ["1001"], "groupNames": {"1001": "One"}, "byGroup": [["One", total]], "parsedTextMessages": total, "parsedMediaMessages": 20,
            "llmSummary": {"summary": summary, "coverage": {"totalTextMessages": total, "includedTextMessages": included}}}


def test_runs_are_read_from_their_folders(spark, tmp_path):
    a, b, c = "run-a-20260719-120000", "run-b-20260720-120000", "run-c-20260718-120000"
    put(tmp_path, f"{a}/analysis/analysis.json", analysis())
    put(tmp_path, f"{a}/exports/groups_1.json", {"groupIds": ["1001"], "startUnix": 100000, "endUnix": 101000, "coveredFromUnix": 100200})
    put(tmp_path, f"{a}/media/media-manifest.json", [{"rowId": "1", "copiedPath": "m/1.png"}, {"rowId": "2"}, {"rowId": "3", "url": "http://x"}])
    put(tmp_path, f"{b}/analysis/analysis.json", {**analysis(30), "byGroup": []})
    put(tmp_path, f"{b}/analysis/digest.json", {"overview": "Two groups", "llmGroups": 2, "groupCount": 2})
    for group, total, used in (("1001", 10, 10), ("1002", 20, 20)):
        put(tmp_path, f"{b}/analysis/groups/{group}/analysis.json", analysis(total, used))
    put(tmp_path, f"{b}/exports/groups_1.json", {"groupIds": ["1001", "1002"], "startUnix": 0, "endUnix": 1000, "coveredFromUnix": None})
    put(tmp_path, f"{c}/analysis/analysis.json", {"groupIds": ["7"], "topics": [{"name": "cats", "count": 2}, {"name": "dogs", "count": 5}, {"name": "none", "count": 0}], "byGroup": []})
    put(tmp_path, "broken/analysis/analysis.json", "{ not json")
    put(tmp_path, "empty/other.txt", "x")
    rows = {r.run_id: r for r in read_runs(spark, str(tmp_path)).collect()}
    assert list(rows) == [b, a, c]
    assert (rows[a].scan_status, rows[a].scan_ratio, rows[a].ai_status, rows[a].groups, rows[a].summary) == ("partial", 0.8, "partial", "One (80)", "Said a lot")
    assert (rows[a].refs, rows[a].copied, rows[a].missing, rows[a].url_only, rows[a].text_messages, rows[a].media_messages) == (3, 1, 1, 1, 80, 20)
    assert (rows[b].scan_status, rows[b].ai_status, rows[b].summary, rows[b].groups) == ("none", "complete", "Two groups", "1001")
    assert (rows[c].scan_status, rows[c].ai_status, rows[c].summary, rows[c].groups, rows[c].text_messages) == ("unknown", "not-used", "dogs / cats", "7", 0)
    assert rn.runs_total(read_runs(spark, str(tmp_path))).first().runs == 3


def test_no_runs(spark, tmp_path):
    assert read_runs(spark, str(tmp_path / "none")).collect() == []
