"""The command line, on a file as a user would write it."""

import pytest

from tidemark import cli
from tidemark.version import __version__


@pytest.fixture
def file(spark, tmp_path):
    path = tmp_path / "models.py"
    path.write_text(f"""
from pyspark.sql import SparkSession
import tidemark
spark = SparkSession.builder.getOrCreate()
db = tidemark.connect(spark, "{tmp_path}/lake")
if not db.exists("bronze"):
    db.source("bronze").append(spark.range(1000).selectExpr("id AS _offset", "id AS value"))

@db.model(source="bronze", sink="silver", start="earliest")
def silver(d):
    return d.where("value > 100")
""")
    return str(path)


def test_run_status_reset(file, capsys):
    said = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    code, out = said("status", file)
    assert code == 0 and out.splitlines()[-1].split() == ["silver", "bronze", "silver", "earliest", "1000"]
    assert said("run", file, "--once")[0] == 0
    assert said("status", file)[1].splitlines()[-1].split()[-2:] == ["999", "0"]
    db = cli.sessions_of(file)[0]
    assert db.table("silver").read().count() == 899
    assert "999 -> earliest" in said("reset", file, "--model", "silver")[1]
    assert said("status", file)[1].splitlines()[-1].split()[-2:] == ["earliest", "1000"]
    assert "earliest -> 10" in said("reset", file, "--model", "silver", "--to", "10")[1]
    said("reset", file, "--model", "silver", "--to", "latest")
    assert said("run", file, "--once", "--model", "silver")[1].endswith("silver: 0 rows\n")


def test_mistakes(file, tmp_path, capsys):
    assert cli.main(["run", file, "--model", "gold"]) == 2 and "no model 'gold'" in capsys.readouterr().err
    assert cli.main(["reset", file, "--model", "gold"]) == 2
    with pytest.raises(SystemExit):
        cli.main(["reset", file, "--model", "silver", "--to", "soon"])
    (tmp_path / "empty.py").write_text("x = 1")
    for bad in (str(tmp_path / "empty.py"), str(tmp_path / "none.py")):
        with pytest.raises(SystemExit):
            cli.main(["status", bad])
    assert cli.main([]) == 0 and "usage" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and __version__ in capsys.readouterr().out
