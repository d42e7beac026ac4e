import json
import struct

import pytest

from bytesmith.cli import main


@pytest.fixture
def files(tmp_path):
    (tmp_path / "s.layout").write_text("// @entry P\nstruct P { a u16 b u16 }")
    (tmp_path / "sum.layout").write_text("struct P { a u8 s u8 check sum8 over(a) }")
    (tmp_path / "four").write_bytes(struct.pack("<HH", 1, 2))
    (tmp_path / "eight").write_bytes(struct.pack("<HH", 1, 3) + b"zzzz")
    (tmp_path / "bad").write_text("struct {")
    return lambda n: str(tmp_path / n)


def test_parse(files, capsys):
    assert main(["parse", files("four"), files("s.layout"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["tree"]["children"][1]["value"]["value"] == 2
    assert main(["parse", files("eight"), files("s.layout"), "--min-coverage", "50"]) == 0 and main(["parse", files("eight"), files("s.layout"), "--min-coverage", "51"]) == 1
    assert main(["parse", files("four"), files("sum.layout")]) == 1 and main(["parse", files("nothing"), files("s.layout")]) == 2 and main(["parse", files("four"), files("s.layout"), "--entry", "Q"]) == 2


def test_others(files, capsys):
    assert main(["diff", files("four"), files("four")]) == 0 and main(["diff", files("four"), files("eight")]) == 1
    assert main(["detect", files("four")]) == 1 and main(["strings", files("eight"), "--at", "0x4"]) == 0 and main(["entropy", files("four")]) == 0 and main(["hints", files("four"), "--at", "9"]) == 1
    assert main(["check", files("s.layout")]) == 0 and main(["check", files("bad")]) == 1 and main(["nonsense"]) == 2


def test_quiet_version_and_entropy(files, capsys):
    assert main(["entropy", files("eight"), "--json", "--buckets", "2"]) == 0
    assert json.loads(capsys.readouterr().out) == {"offset": 0, "len": 8, "bucket_bytes": 4, "values": [0.1875, 0.0]}
    for verb in (["entropy", files("eight")], ["parse", files("sum.layout"), files("sum.layout")], ["diff", files("four"), files("eight")], ["strings", files("eight")], ["check", files("bad")]):
        main([*verb, "-q"])
    out = capsys.readouterr()
    assert out.out == out.err == ""
    assert main(["--version"]) == 0 and capsys.readouterr().out.startswith("bytesmith ")
