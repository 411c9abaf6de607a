"""python -m keystrata: the keywords of a text or a file."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from keystrata.api import extract_keywords
from keystrata.options import SIMILARITIES

HELP = """Usage: keystrata [OPTIONS]

Options:
  -ti, --text-input TEXT     The text itself; goes before --input-file
  -i, --input-file TEXT      A UTF-8 file
  -l, --language TEXT        Language
  -n, --ngram-size INTEGER   Words of a phrase at most
  -df, --dedup-func TEXT     Similarity of phrases (levs|jaro|seqm)
  -dl, --dedup-lim FLOAT     Similarity above which a phrase is left out
  -ws, --window-size INT     Words that a word co-occurs with
  -t, --top INTEGER          Number of keywords
  -s, --stopwords TEXT       A file with one stopword a line
  -v, --verbose              Scores too, as JSON
  --help                     Show this message
"""
#: Flags with a value: option and whether it is a number.
FLAGS = {
    ("-ti", "--text-input"): ("text_input", False), ("-i", "--input-file"): ("input_file", False), ("-l", "--language"): ("language", False),
    ("-n", "--ngram-size"): ("n", True), ("-df", "--dedup-func"): ("dedup_func", False), ("-dl", "--dedup-lim"): ("dedup_lim", True),
    ("-ws", "--window-size"): ("window", True), ("-t", "--top"): ("top", True), ("-s", "--stopwords"): ("stopwords", False),
}
BY_FLAG = {flag: to for flags, to in FLAGS.items() for flag in flags}


@dataclass
class Args:
    given: dict = field(default_factory=dict)
    verbose: bool = False
    help: bool = False
    errors: list[str] = field(default_factory=list)


def parse(argv: list[str]) -> Args:
    """The arguments, with all that is wrong with them; unknown ones are passed over."""
    args, rest = Args(), iter(argv)
    for flag in rest:
        if flag in ("-v", "--verbose"):
            args.verbose = True
        elif flag == "--help":
            args.help = True
        elif flag in BY_FLAG:
            name, numeric = BY_FLAG[flag]
            value = next(rest, None)
            if value is None:
                args.errors.append(f"{flag} requires a value")
            elif not numeric:
                args.given[name] = value
            else:
                try:
                    number = float(value or 0)
                    if math.isnan(number):
                        raise ValueError
                    args.given[name] = int(number) if number.is_integer() else number
                except ValueError:
                    args.errors.append(f"{flag} must be numeric")
    return args


def mistakes(args: Args) -> list[str]:
    """Every message for arguments that can't be used."""
    out, given = list(args.errors), args.given
    if args.help:
        return out
    if not given.get("text_input") and not given.get("input_file"):
        out.append("either --text-input or --input-file is required")
    for name, flag in (("n", "--ngram-size"), ("top", "--top"), ("window", "--window-size")):
        if name in given and (not isinstance(given[name], int) or given[name] <= 0):
            out.append(f"{flag} must be a positive integer")
    if not 0 <= given.get("dedup_lim", 0) <= 1:
        out.append("--dedup-lim must be between 0 and 1")
    if given.get("dedup_func", "seqm").lower() not in SIMILARITIES:
        out.append("--dedup-func must be one of levs, jaro, seqm")
    return out


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def main(argv: list[str] | None = None, out: Callable[[str], object] = sys.stdout.write, err: Callable[[str], object] = sys.stderr.write) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    if args.help:
        out(HELP)
        return 0
    if wrong := mistakes(args):
        err("\n".join(wrong) + "\n")
        out(HELP)
        return 1
    given = dict(args.given)
    text, path, listed = given.pop("text_input", None), given.pop("input_file", None), given.pop("stopwords", None)
    given.setdefault("language", "en")
    try:
        text = text if text is not None else _read(path)
        words = _read(listed) if listed else ""
    except (OSError, UnicodeDecodeError) as e:
        err(f"failed to read input file: {e}\n")
        return 1
    found = extract_keywords(text, {given["language"]: words}, **given)
    out((json.dumps(found, ensure_ascii=False, indent=2) if args.verbose else "\n".join(k for k, _ in found)) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
