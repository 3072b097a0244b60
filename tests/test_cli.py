from webloom import cli


def test_cells_from_a_shell(spark, capsys):
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)[1]
    run("delete", "pt-cli")
    assert run("get", "pt-cli", "a", "x").strip() == "" and run("scan", "pt-cli") == ""
    run("put", "pt-cli", "a", "x", "1")
    run("put", "pt-cli", "a", "x", "2")
    run("put", "pt-cli", "b", "y", "3")
    assert run("get", "pt-cli", "a", "x").strip() == "2"
    assert run("scan", "pt-cli").splitlines() == ["a\tx\t2", "b\ty\t3"] and run("scan", "pt-cli", "b").splitlines() == ["b\ty\t3"]
    run("delete", "pt-other")
    run("rename", "pt-cli", "pt-other")
    assert "pt-other" in run("tables") and run("scan", "pt-cli") == ""
    run("delete", "pt-other")
