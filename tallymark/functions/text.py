"""Text expressions: words, token cleaning, prompts and reply handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The widely used English stop word list.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split()

# Word boundaries in the Unicode sense: anything but a letter, number or underscore.
NON_WORD = r"[^\p{L}\p{N}_]+"
# Blanks in the Unicode sense.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
# Runs of them other than one space; the first part rules out most letters at once.
ODD_BLANKS = r"[\x00-\x1f\x{85}-\x{10ffff}&&[\t-\r\x1c-\x1f\x{85}\p{Z}]][\t-\r\x1c-\x20\x{85}\p{Z}]*| [\t-\r\x1c-\x20\x{85}\p{Z}]+"
# What token cleaning removes: all but letters, non-decimal numbers, underscore
# and the blanks that separate tokens.
NOISE = r"[^\p{L}\p{Nl}\p{No}_\t-\r\x1c-\x20\x{85}\p{Z}]+"

# The instruction template; its later lines are indented.
INSTRUCTION_TEMPLATE = """Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.

    ### Instruction:
    {}

    ### Input:
    {}

    ### Response:
    {}"""

# The two example pairs shown before a sentence to translate.
TRANSLATION_EXAMPLES = (
    ("Ich liebe Programmierung.", "I love programming."),
    ("Guten Morgen!", "Good morning!"),
)

# Turn markers of the default chat format, by role.
CHAT_ROLES = {"system": "user", "user": "user", "assistant": "model"}
TURN_START, TURN_END = "<start_of_turn>", "<end_of_turn>"

# Stop strings in the order they are tried.
STOP_STRINGS = ("<|eot_id|>", "<|end_of_text|>", "</s>", "<|im_end|>", "<|end|>",
                "<end_of_turn>", "<start_of_turn>", "<|start_header_id|>")

# How a question-answering conversation is opened.
CONTEXT_MESSAGE = "You are a helpful assistant. Your task is to answer the question with this context: "


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_runs(text: str | Column) -> Column:
    """All maximal runs of word characters of the lower-cased text, in order."""
    return F.split(F.lower(F.coalesce(_column(text), F.lit(""))), NON_WORD)


def is_counted_word(word: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Runs of two or more ASCII letters that are not stop words."""
    return word.rlike("^[a-z]{2,}$") & ~word.isin(list(stop_words))


def clean_tokens(text: str | Column) -> Column:
    """Lower-cased blank-separated tokens without punctuation and digits.

    Cleaning the whole text first gives the same tokens as cleaning one by one,
    since blanks are kept. Empty tokens are left in. Runs of blanks that are not
    one space become one first, as Spark splits by a plain character several
    times faster than by an expression.
    """
    kept = F.regexp_replace(F.lower(F.coalesce(_column(text), F.lit(""))), NOISE, "")
    return F.split(F.regexp_replace(kept, ODD_BLANKS, " "), " ")


def clean_token(token: str | Column) -> Column:
    """One token without punctuation, blanks and digits."""
    return F.regexp_replace(_column(token), r"[^\p{L}\p{Nl}\p{No}_]+", "")


def render_prompt(instruction: str | Column, given: str | Column, output: str | Column, end_token: str) -> Column:
    """The instruction template filled in, closed by the end token."""
    pieces = INSTRUCTION_TEMPLATE.split("{}")
    fields = [_column(instruction), _column(given), _column(output)]
    parts = [F.lit(pieces[0])]
    for field, piece in zip(fields, pieces[1:]):
        parts += [F.coalesce(field, F.lit("")), F.lit(piece)]
    return F.concat(*parts, F.lit(end_token))


def translation_suffix(source: str | Column, src_lang: str, ref_lang: str) -> Column:
    """The open last pair of a translation prompt."""
    return F.concat(F.lit(f"{src_lang}: "), _column(source), F.lit(f"\n{ref_lang}:"))


def render_few_shot(source: str | Column, src_lang: str, ref_lang: str,
                    examples: Sequence[tuple[str, str]] = TRANSLATION_EXAMPLES) -> Column:
    """Header, example pairs, then the source with an open target."""
    shown = "".join(f"{src_lang}: {a}\n{ref_lang}: {b}\n\n" for a, b in examples)
    # Fixed value: the header of a translation prompt.
    header = f"Translate the following {src_lang} sentences into {ref_lang}.\n\n"
    return F.concat(F.lit(header + shown), translation_suffix(source, src_lang, ref_lang))


def chat_turn(role: str | Column, content: str | Column) -> Column:
    """One rendered message; the empty text for an unknown role."""
    role, content = _column(role), F.coalesce(_column(content), F.lit(""))
    speaker = F.when(F.lit(False), F.lit(""))
    for known, shown in CHAT_ROLES.items():
        speaker = speaker.when(role == known, F.lit(shown))
    text = F.concat(F.lit(TURN_START), speaker, F.lit("\n"), content, F.lit(f"{TURN_END}\n"))
    return F.coalesce(text, F.lit(""))


def cut_at_stop(reply: str | Column, stops: Sequence[str] = STOP_STRINGS) -> Column:
    """Cut at the first listed stop string that occurs at all."""
    reply = _column(reply)
    cut = reply
    for stop in reversed(list(stops)):
        cut = F.when(F.contains(reply, F.lit(stop)), F.substring_index(reply, stop, 1)).otherwise(cut)
    return cut


PYTHON_STRIP = r"^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+\z"


def strip_blanks(text: str | Column) -> Column:
    """Trim Unicode blanks and line ends on both sides."""
    return F.regexp_replace(_column(text), PYTHON_STRIP, "")


def extract_prediction(full: str | Column, suffix: str | Column) -> Column:
    """First line of what follows the last occurrence of the prompt suffix.

    The suffix may differ per row; a missing one leaves the whole text.
    """
    after = F.call_function("substring_index", _column(full), _column(suffix), F.lit(-1))
    return strip_blanks(F.substring_index(strip_blanks(after), "\n", 1))
