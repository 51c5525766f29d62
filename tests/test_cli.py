"""The command line on the smallest tables."""

import os

import pytest

from voxfield import cli

SF = "/root/testdata/sf0.001"


def test_list_and_errors(capsys):
    assert cli.main(["list"]) == 0 and "weekly_trend (with SQL)" in capsys.readouterr().out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark, tmp_path, capsys):
    assert cli.main(["run", "weekly_trend", "--data", SF, "--out", f"{tmp_path}/o", "--format", "csv"], spark) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/o").count() > 0
    assert cli.main(["explain", "weekly_trend", "--data", SF], spark) == 0 and "HashAggregate" in capsys.readouterr().out
    assert cli.main(["run", "nothing"], spark) == 2
    assert cli.main(["doctor", "--data", SF], spark) == 0 and cli.main(["doctor", "--data", str(tmp_path)], spark) == 1
