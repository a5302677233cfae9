import json

from fidelis import cli
from fidelis.operators import gate
from fidelis.sources import bundle, frames


def test_commands(spark, tmp_path, capsys):
    a, b, c = (frames.packed(bytes([v, 10, 20, 255] * 4), 2, 2, "rgba8") for v in (0, 5, 50))
    for name, f in (("a", a), ("b", b), ("c", c)):
        (tmp_path / f"{name}.png").write_bytes(frames.write_png(f))
    p = lambda n: str(tmp_path / n)

    def run(*argv):
        status = cli.main(list(argv))
        return status, capsys.readouterr().out

    status, out = run("compare", p("a.png"), p("b.png"), "--metrics", "mse:color,psnr", "--gate", "psnr>=40")
    report = json.loads(out)
    assert status == 0 and [m["name"] for m in report["metrics"]] == ["mse:color", "psnr"] and report["checks"][0]["passed"]
    assert run("gate", p("a.png"), p("c.png"), "--gate", "psnr>=90")[0] == 1
    status, out = run("suite", p("a.png"), p("c.png"), p("b.png"), "--label", "far", "--label", "near", "--baseline", "far", "--gate", "mse<=baseline", "--weight", "psnr=2")
    ranked = {r["candidate"]: r for r in json.loads(out)}
    assert status == 0 and ranked["near"]["overall_rank"] == 1 and ranked["near"]["pareto_optimal"] and ranked["far"]["baseline_deltas"]["mse"] == 0
    assert json.loads(run("stats", p("a.png"))[1])[0]["color_balance"]["dominant_channel"] == "blue"
    assert run("diff", p("a.png"), p("c.png"), "--output", p("d.png"))[0] == 0
    assert run("pack", p("a.png"), p("b.png"), "--output", p("x.bundle"), "--tag", "1:ref", "--tag", "all:t")[0] == 0
    info = run("bundle-info", p("x.bundle"), "--format", "csv")[1].splitlines()
    assert len(info) == 3 and "ref,t" in info[1]
    rows = bundle.compare_records((tmp_path / "x.bundle").read_bytes(), "ref", 1, "mae:color")
    assert round(rows[0]["score"] * 255 * 3, 6) == 5
    assert "png" in run("formats", "--format", "yaml")[1] and cli.main(["stats", p("x.bundle")]) == 2


def test_gate_report(spark):
    rows = spark.createDataFrame([("a", 0, "psnr", 41.0, "dB", "higher", {})], "label string, pos int, name string, score double, unit string, direction string, details map<string,double>")
    r = gate.report(rows, gate.evaluate(rows, ["label"], ["psnr>=40"]), ["label"]).first()
    assert r.passed and r.metrics[0].name == "psnr" and r.checks[0].metric == "psnr"
