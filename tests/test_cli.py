import json

from millrace.__main__ import main
from millrace.model import pipeline


def test_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    good, bad, failing = (str(tmp_path / f"{n}.json") for n in ("good", "bad", "failing"))
    out = str(tmp_path / "o.csv")
    steps = (("a", "src.file.csv", {"path": "${workspace}/a.csv"}), ("f", "xf.filter", {"predicate": "k >= ${least}"}), ("w", "snk.file.csv", {"path": out}))
    open(good, "w").write(pipeline(*steps, name="p", parameters={"least": {"type": "integer", "default": 1}}).to_json())
    open(bad, "w").write(pipeline(("a", "src.nowhere", {})).to_json())
    open(failing, "w").write(pipeline(("a", "src.file.csv", {"path": "/no/such"})).to_json())
    at = ["--workspace", str(tmp_path)]
    assert main(["validate", good, *at]) == 0
    assert main(["validate", bad, *at]) == 2
    assert main(["validate", good + ".not", *at]) == 1
    assert main(["what"]) == 1
    assert main(["run", good, *at, "--param", "least=2"]) == 0
    assert open(out).read() == "k,v\n2,y\n"
    assert main(["run", failing, *at]) == 3
    assert main(["run", good, *at, "--param", "least=x"]) == 2
    capsys.readouterr()
    assert main(["preview", good, "f", *at]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [{"k": 1, "v": "x"}, {"k": 2, "v": "y"}]
    for command in (["plan", good, *at], ["lineage", good, *at], ["runs", good, *at], ["state", good, *at, "--reset"], ["components"], ["schema"]):
        assert main(command) == 0
        json.loads(capsys.readouterr().out)
