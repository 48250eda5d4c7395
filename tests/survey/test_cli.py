import json

import pytest

from swathframe.plans import cli
from swathframe.streaming.events import Reporter


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    f = tmp_path / "gcp.csv"
    f.write_text("name,x,y,z\nA,200000,600000,1\n")
    assert cli.main(["points", str(f), "5186"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["name"] == "A"
    assert cli.main(["points", str(f), "3857"]) == 1 and "invalid_argument" in capsys.readouterr().err
    assert cli.main(["info", f"file://{tmp_path}/none"]) == 1 and "not_aligned" in capsys.readouterr().err
    assert cli.main(["indices", "--bands", "nir,red"]) == 0 and '"available": true' in capsys.readouterr().out
    assert cli.run("doctor", {}, Reporter(), spark)["works"]
    assert cli.run("look", {"file": str(f)}, Reporter(), spark)["guess"] == {"name": 0, "x": 1, "y": 2, "z": 3}
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2
