import numpy as np
import pytest

from tidepool.__main__ import main


def test_ledger(spark, tmp_path, capsys):
    rows = [(i, i * 10, i % 4, -5.0 if i % 2 else 5.0, float(i)) for i in range(20)]
    path, out = str(tmp_path / "ledger"), str(tmp_path / "out")
    spark.createDataFrame(rows, "row_id long, sample_index long, channel_index long, amplitude_uv double, snr double").write.parquet(path)
    main(["ledger", path, "--snr", "4", "--polarity", "neg", "--stop", "150"])
    assert '{"rows": 5}' in capsys.readouterr().out
    main(["ledger", path, "--snr", "4", "--channels", "1", "--out", out])
    assert sorted(r.row_id for r in spark.read.parquet(out).collect()) == [5, 9, 13, 17]


def test_lfp_and_quality(spark, tmp_path, capsys):
    np.zeros((4000, 2), "<i2").tofile(tmp_path / "a.dat")
    main(["lfp", str(tmp_path / "a.dat"), str(tmp_path / "lfp"), "--channels", "2", "--rate", "10000", "--out-rate", "2500", "--passband", "900"])
    assert '"outputs": 1000' in capsys.readouterr().out
    times = spark.createDataFrame([(i * 100, i % 2) for i in range(40)], "t long, label long")
    times.write.parquet(str(tmp_path / "truth"))
    main(["quality", str(tmp_path / "truth"), str(tmp_path / "truth"), "--tolerance", "3"])
    assert capsys.readouterr().out.split() == "+-----+------+---+ |label|label2|iou| +-----+------+---+ |0 |0 |1.0| |1 |1 |1.0| +-----+------+---+".split()


def test_queries_and_usage(capsys):
    main(["queries"])
    assert "residual_matches (no SQL twin)" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["ledger"])


def test_ledgers_samples_and_suites(spark, tmp_path, capsys):
    from tidepool.sources.ledger_store import write_ledger

    events = spark.createDataFrame([(i * 7, i % 4, -10.0 - i, 5.0 + i / 2) for i in range(60)], "sample_index long, channel_index long, amplitude_uv double, snr double")
    noise = spark.createDataFrame([(c, 2.0) for c in range(4)], "channel_index long, noise_uv double")
    path = f"file://{tmp_path}/ledger"
    write_ledger(events, noise, path, 3.0, 0, 500, 100)
    assert main(["inspect", path]) == 0 and '"rows": 60' in capsys.readouterr().out
    main(["export", path, str(tmp_path / "out"), "--snr", "20", "--stop", "300", "--polarity", "neg"])
    assert sorted(r.row_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(31, 43))
    spark.createDataFrame([(c, 0.0, 20.0 * c, 0) for c in range(4)], "channel_index long, x double, y double, shank int").write.parquet(str(tmp_path / "channels"))
    main(["sample", path, str(tmp_path / "channels"), f"file://{tmp_path}/sample", "--budget", "20", "--least", "1"])
    assert '"selected": 20' in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "sample" / "uniform")).count() == 20
    truth = spark.createDataFrame([(i * 100, i % 2) for i in range(40)], "t long, label long")
    truth.write.parquet(str(tmp_path / "truth"))
    truth.where("t % 300 <> 0").write.parquet(str(tmp_path / "worse"))
    main(["score", str(tmp_path / "truth"), str(tmp_path / "worse"), "--tolerance", "3"])
    assert '"true_positives":26' in capsys.readouterr().out
    for session, code in (("worse", 2),):
        cases = [{"name": k, "kind": k, "truth": str(tmp_path / "truth"), "session": str(tmp_path / session), "baseline": str(tmp_path / "truth"), "tolerance": 3} for k in ("base", "drift", "collision")]
        (tmp_path / "cases.json").write_text(__import__("json").dumps(cases))
        assert main(["suite", f"file://{tmp_path}/cases.json"]) == code
