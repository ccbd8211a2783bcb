"""The commands, one after another, on a small corpus."""

import json

from lexloom import cli
from lexloom.functions.tokenizer import Tokenizer


def test_commands(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "a.bin").write_bytes(b"the thing in the ring\0then the king\r\nsings\0" * 20)
    (tmp_path / "special.json").write_text(json.dumps(["<s>"]))
    run = lambda *a: cli.main(list(a), lambda: spark)
    run("regex")
    assert "space-lowercase-word" in capsys.readouterr().out
    run("regex", "-o", at("r.regex"), "-p", "space-lowercase-word", "-p", "any-char")
    run("generate", "-v", "300", "-o", at("g.json"), "--train", f"a:{at('a.bin')}", "--processor", "crlf", "--special", at("special.json"), "--allow", at("r.regex"), "--insert-probability", "1")
    tok = Tokenizer.from_file(at("g.json"))
    assert tok.base_vocab_size() > 255 and tok.special_tokens() == ["<s>"] and tok.processors == ["crlf"]
    run("prune", "-i", at("g.json"), "-o", at("p.json"), "-v", "265", "--train", f"a:{at('a.bin')}")
    assert 255 <= Tokenizer.from_file(at("p.json")).base_vocab_size() <= 265
    run("filter", "-i", at("p.json"), "-o", at("f.json"), "-v", "258", "--min-score", "0")
    assert Tokenizer.from_file(at("f.json")).base_vocab_size() <= 258
    run("merge", "-i", at("f.json"), "-o", at("m.json"), "--train", f"a:{at('a.bin')}", "--allow", "space-lowercase-word", "--num-merges", "4", "--step", "2")
    assert Tokenizer.from_file(at("m.json")).base_vocab_size() == Tokenizer.from_file(at("f.json")).base_vocab_size() + 4
    run("mine", "-n", "2", "-o", at("i.json"), "--train", f"a:{at('a.bin')}", "-p", "lowercase-word")
    assert json.loads((tmp_path / "i.json").read_text()) == ["the", "in"]
    run("encode", "-v", at("m.json"), "-i", at("a.bin"), "-o", at("ids"))
    run("decode", "-v", at("m.json"), "-i", at("ids"), "-o", at("back"))
    assert {r[0] for r in spark.read.option("lineSep", "\0").text(at("back")).collect()} == {"the thing in the ring", "then the king\nsings"}
    run("evaluate", "-v", at("m.json"), "-o", at("e.json"), "--train", f"a:{at('a.bin')}")
    report = json.loads((tmp_path / "e.json").read_text())
    assert report["compression"]["a"]["num_chars"] == 20 * 41 and len(report["frequency_buckets"]) == 50
