"""Sentence segmentation over text tables and text streams, on Spark DataFrames."""

from clausemill.api import (
    Config,
    ConfigBuilder,
    ProcessingMetadata,
    Processor,
    Sentence,
    SentenceIterator,
    SentenceSplitter,
    iter_split,
    load,
    split,
    split_large_file,
    supported_languages,
)
from clausemill.config import (
    AbbreviationConfig,
    ContextRule,
    EllipsisConfig,
    EnclosureConfig,
    EnclosurePair,
    ExceptionPattern,
    FastPattern,
    Language,
    LanguageConfig,
    MetadataConfig,
    RegexPattern,
    SentenceStarterConfig,
    SuppressionConfig,
    TerminatorConfig,
    TerminatorPattern,
)
from clausemill.errors import ConfigurationError, InvalidInputError, InvalidLanguageError, ProcessingError, SegmentationError, UnsupportedError

__version__ = "0.1.0"
