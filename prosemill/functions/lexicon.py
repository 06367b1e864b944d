"""Word lists and feature names."""

from __future__ import annotations

#: The feature vector's order. Names can be appended, never moved.
FEATURE_NAMES: tuple[str, ...] = (
    "perplexity",
    "mean_token_logprob",
    "std_token_logprob",
    "median_token_logprob",
    "mean_token_entropy",
    "burstiness",
    "sentence_length_mean",
    "sentence_length_std",
    "sentence_length_cv",
    "perplexity_burstiness",
    "sentence_perplexity_mean",
    "sentence_perplexity_std",
    "type_token_ratio",
    "hapax_ratio",
    "avg_word_length",
    "stopword_ratio",
    "punctuation_density",
    "comma_per_sentence",
    "discourse_marker_ratio",
    "contraction_ratio",
    "uppercase_ratio",
    "digit_ratio",
)

#: Abbreviations whose period ends no sentence.
ABBREVIATIONS: tuple[str, ...] = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g",
    "i.e", "approx", "dept", "univ", "inc", "ltd", "co", "fig", "no", "vol",
    "al", "ph.d", "b.a", "m.a", "u.s", "u.k",
)

#: Function words.
STOPWORDS: tuple[str, ...] = tuple(
    """a an the and or but if while of to in on at by for with about against
    between into through during before after above below from up down out off
    over under again further then once here there all any both each few more
    most other some such no nor not only own same so than too very s t can will
    just don should now i me my myself we our ours ourselves you your yours he
    him his she her hers it its they them their what which who whom this that
    these those am is are was were be been being have has had having do does
    did doing as because until""".split()
)

#: Connectives.
DISCOURSE_MARKERS: tuple[str, ...] = tuple(
    """however moreover furthermore additionally consequently therefore thus
    nevertheless nonetheless meanwhile similarly conversely notably importantly
    ultimately overall subsequently accordingly hence whereas""".split()
)

#: Patterns of words, tokens and sentence ends.
WORD = "[A-Za-z][A-Za-z'’-]*"
TOKEN = r"(?U)\S+"
CONTRACTION = r"(?iU)\b\w+['’](?:t|s|re|ve|ll|d|m)\b"
CLOSERS = "[\"'”’)\\]]"
