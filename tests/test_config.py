import pytest

from clausemill.config import AbbreviationConfig, EllipsisConfig, EnclosureConfig, LanguageConfig, MetadataConfig, SentenceStarterConfig, SuppressionConfig, TerminatorConfig, bundled, resolve_code
from clausemill.errors import ConfigurationError, InvalidLanguageError
from clausemill.kernel import Rules
from clausemill.queries import CUSTOM


@pytest.mark.parametrize("code", ["en", "ja"])
def test_round_trip(code, tmp_path):
    path = tmp_path / "x.toml"
    bundled(code).to_toml(path)
    assert LanguageConfig.from_toml(path) == bundled(code)


@pytest.mark.parametrize(("name", "code"), [(" EN ", "en"), ("english", "en"), ("jpn", "ja"), ("Japanese", "ja")])
def test_names(name, code):
    assert resolve_code(name) == code


def test_unknown_name():
    with pytest.raises(InvalidLanguageError):
        resolve_code("fr")


@pytest.mark.parametrize(
    ("old", "new"),
    [
        ('code = "x"', 'code = ""'),
        ('name = "Custom"', 'name = ""'),
        ('chars = [".", ";", "!"]', "chars = []"),
        ('chars = [".", ";", "!"]', 'chars = ["ab"]'),
        ('some = ["bzw", "d.h"]', "some = []"),
        ("[suppression]", "[suppressed]"),
        ('patterns = [".."]', ""),
        ("min_word_length = 2\nsome = [\"Der\", \"I\"]", "min_word_length = 2"),
        ("fast_patterns =", "regex_patterns = [{ pattern = '(' }]\nfast_patterns ="),
        ("fast_patterns =", "regex_patterns = [{ pattern = '(?=a)' }]\nfast_patterns ="),
        ("[metadata]", "[metadata"),
    ],
)
def test_bad_rules(old, new):
    assert old in CUSTOM
    with pytest.raises(ConfigurationError):
        LanguageConfig.from_text(CUSTOM.replace(old, new))


def _plain(**more):
    return LanguageConfig(MetadataConfig("x", "X"), TerminatorConfig(["."]), EllipsisConfig(patterns=[]), EnclosureConfig(), SuppressionConfig(), AbbreviationConfig(), **more)


def test_patterns_must_fit_into_the_window():
    config = _plain()
    config.ellipsis.patterns = ["." * 32]
    with pytest.raises(ConfigurationError):
        Rules(config)


def test_starters_by_category():
    starters = SentenceStarterConfig(min_word_length=2, some=["A", "Ab"])
    starters["more"] = ["Cd"]
    assert Rules(_plain(sentence_starters=starters)).starters == {"Ab", "Cd"}
