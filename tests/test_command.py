import pytest

from loamframe.__main__ import main


def test_names_are_listed(capsys):
    assert main([]) == 0 and "cube_statistics" in capsys.readouterr().out


def test_a_query_runs(spark, sf, capsys, tmp_path):
    assert main(["zonal_mean", sf]) == 0 and "r_name" in capsys.readouterr().out
    assert main(["zonal_mean", sf, "--out", str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() > 0
    with pytest.raises(SystemExit):
        main(["nothing", sf])
