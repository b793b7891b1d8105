import io
import random

import pytest

import clausemill
from clausemill.api import Feeder
from clausemill.cli import main
from clausemill.config import bundled
from clausemill.kernel import Rules


def test_split_and_details():
    assert clausemill.split("") == [] and clausemill.SentenceSplitter().split("") == [""]
    assert clausemill.split("First sentence.    Second one.  Third!", preserve_whitespace=True) == ["First sentence.", "    Second one.", "  Third!"]
    assert clausemill.split("Hello.\n", preserve_whitespace=True) == ["Hello."]
    found = clausemill.split("First sentence. Second one. Third! Fourth?", return_details=True)
    assert [(s.start, s.end) for s in found] == [(0, 15), (15, 27), (27, 34), (34, 42)] and found[0].confidence == 1.0
    assert clausemill.split("終わり。はい。", language="japanese") == ["終わり。", "はい。"]


def test_inputs(tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"One. Two.")
    for source in (path, str(path), b"One. Two.", io.StringIO("One. Two."), io.BytesIO(b"One. Two.")):
        assert clausemill.split(source) == ["One.", "Two."]
    assert clausemill.split("/path/that/does/not/exist.txt") == ["/path/that/does/not/exist.", "txt"]
    assert clausemill.split("﻿Text with BOM. Ok.".encode())[0] == "﻿Text with BOM."
    assert clausemill.split("caf\xe9. Ok.".encode("latin-1"), encoding="latin-1")[0] == "café."
    with pytest.raises(FileNotFoundError):
        clausemill.split(tmp_path / "none.txt")
    with pytest.raises(TypeError):
        clausemill.split(3)
    with pytest.raises(LookupError):
        clausemill.split(b"a", encoding="nope")
    with pytest.raises(clausemill.ProcessingError):
        clausemill.split(b"\xff")


def test_errors():
    with pytest.raises(clausemill.InvalidLanguageError):
        clausemill.split("a", language="eng")
    with pytest.raises(clausemill.ConfigurationError):
        clausemill.split("a", threads=0)
    with pytest.raises(clausemill.ConfigurationError):
        clausemill.split("a", execution_mode="fast")
    assert issubclass(clausemill.ConfigurationError, clausemill.SegmentationError)


def test_splitter():
    with clausemill.load("en") as s:
        assert repr(s) == "SentenceSplitter(language='en', threads=None, chunk_kb=256)" and s.supports_parallel
        assert list(s.iter_split("A b. C d.")) == ["A b.", "C d."]
        places, stats = s.process("Hélo. Holo. x")
        assert places == [(6, 5), (12, 11)] and stats["sentence_count"] == 2
    assert clausemill.SentenceSplitter(language_config=bundled("ja")).language == "custom(ja)"


def test_large_file(tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("x" * 262_244 + "\nHello.\nWorld.\n")
    assert len(list(clausemill.split_large_file(path, max_memory_mb=1))) == 2
    path.write_text("Hello.\n" * 74_752)
    assert len(list(clausemill.split_large_file(path, max_memory_mb=1))) == 74_752


def test_fragments_do_not_matter():
    rng, rules = random.Random(3), Rules.of("en")
    for _ in range(300):
        text = "".join(rng.choice(["Dr", ".", "...", " ", "(", ")", "'", '"', "a", "The", "um...", "5", "é", "😀", "!?"]) for _ in range(rng.randint(0, 90)))
        feeder, out, at = Feeder(rules), [], 0
        while at < len(text):
            n = rng.randint(1, 40)
            out += feeder.feed(text[at : at + n])
            at += n
        assert out + feeder.feed("", last=True) == [t for _, _, t in rules.slices(text)]


def test_command_line(tmp_path, capsys):
    (tmp_path / "b.txt").write_text("Hélo. Holo.\n")
    (tmp_path / "a.txt").write_text("One. Two.")
    assert main(["process", "-i", str(tmp_path / "*.txt"), "-f", "markdown"]) == 0
    assert capsys.readouterr().out == "1. One.\n2. Two.\n3. Hélo.\n4. Holo.\n\n---\n*Total sentences: 4*\n"
    assert main(["process", "-i", str(tmp_path / "b.txt"), "-f", "json"]) == 0
    assert '"offset": 6,\n    "length": 5' in capsys.readouterr().out
    assert main(["generate-config", "-l", "xx", "-o", str(tmp_path / "x.toml")]) == 0
    assert main(["validate", "-c", str(tmp_path / "x.toml")]) == 0
    assert main(["process", "-i", str(tmp_path / "none*"), "-q"]) == 1
    assert main(["list", "formats"]) == 0


def test_options_and_languages():
    config = clausemill.Config.builder().language("english").chunk_size(8192).threads(2).build()
    assert clausemill.SentenceSplitter.with_config(config).language == "en" and config.parts(1) == 2
    assert clausemill.Config().parts(10) == 1 and clausemill.Config.streaming().threads == 2
    with pytest.raises(clausemill.InvalidLanguageError):
        clausemill.Config.builder().language("xx").build()
    with pytest.raises(clausemill.ConfigurationError):
        clausemill.Config(chunk_size=0)
    assert clausemill.Language.from_code("xx") is clausemill.Language.ENGLISH and clausemill.Language.parse(" JPN ") is clausemill.Language.JAPANESE
    with pytest.raises(clausemill.InvalidInputError):
        clausemill.split(b"\xff")
    assert clausemill.SentenceSplitter.with_language("jpn").process_stream(io.StringIO("はい。"))[0] == [(9, 3)]


def test_modes_cut_texts_into_parts():
    text = "It rained (a lot. really). We ran! " * 400
    want = clausemill.split(text)
    for mode in ("sequential", "parallel", "adaptive"):
        for threads, chunk in ((1, 1), (3, 1), (None, None)):
            assert clausemill.split(text, threads=threads, chunk_kb=chunk, execution_mode=mode) == want
            places, stats = clausemill.SentenceSplitter(threads=threads, chunk_kb=chunk, execution_mode=mode).process(text)
            assert len(places) == stats["sentence_count"] == len(want)
            if mode == "parallel":
                assert stats["strategy_used"] == "parallel" and stats["chunks_processed"] == (-(-len(text) // 1024) if chunk else 1)
    assert clausemill.SentenceSplitter(threads=2, chunk_kb=1).process(text)[1]["strategy_used"] == "parallel"
    assert clausemill.SentenceSplitter().process("Short. Text.")[1]["strategy_used"] == "sequential"


def test_files_in_parts(tmp_path, capsys, monkeypatch):
    from clausemill import cli

    text = "Hé said (no. way) so. Then!  We ran…  And on\n" * 60_000
    (tmp_path / "a.txt").write_text(text)
    outputs = []
    for more in ([], ["--stream", "--stream-chunk-mb", "1"]):
        for kind in ("json", "text", "markdown"):
            assert main(["process", "-i", str(tmp_path / "a.txt"), "-f", kind, "-q", *more]) == 0
            outputs.append(capsys.readouterr().out)
    assert outputs[:3] == outputs[3:] and len(text.encode()) > 2 << 20
    assert not cli.should_stream(str(tmp_path / "a.txt"), 1)
    monkeypatch.setattr(cli.os.path, "getsize", lambda p: 11 << 20)
    assert cli.should_stream("x", 1)
    (tmp_path / "bad.txt").write_bytes(b"ok. \xff")
    assert main(["process", "-i", str(tmp_path / "bad.txt"), "--stream", "-q"]) == 1


def test_progress(capsys):
    from clausemill.cli import Progress

    bar = Progress(2, True)
    bar.step("/x/a.txt")
    bar.step("/x/b.txt")
    bar.finish()
    assert "1/2 a.txt" in (err := capsys.readouterr().err) and "2/2 b.txt" in err
    Progress(1, False).step("a")
    assert capsys.readouterr().err == ""
