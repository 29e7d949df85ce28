"""Licence scan: one automaton finds tags and notice phrases, a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import automaton, map_texts, phrase, read_table, word_bytes

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that the operator knows besides them.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAG = "spdx license identifier"
# Forms of the identifiers that expressions may name, each with its family; and the exceptions after 'with'.
IDENTIFIERS = {
    r"AGPL(-?v?[1-3](\.0)?)?(-only|-or-later|\+)?": "agpl",
    r"LGPL(-?v?[23](\.[01])?)?(-only|-or-later|\+)?": "lgpl",
    r"GPL(-?v?[1-3](\.0)?)?(-only|-or-later|\+)?": "gpl",
    r"Apache(-[12]\.[01])?": "apache",
    r"CC-BY(-NC)?(-SA|-ND)?(-[1-4]\.[05])?": "cc-by",
    r"CC0(-1\.0)?": "cc0",
    r"MIT(-0|-CMU|-Modern-Variant)?": "mit",
    r"0BSD|BSD(-[1-4]-Clause(-Patent|-Clear|-LBNL|-UC)?)?": "bsd",
    r"MPL(-[12]\.[01](-no-copyleft-exception)?)?": "mpl",
    r"EPL(-[12]\.0)?": "epl",
    r"EUPL(-1\.[0-2])?": "eupl",
    r"CDDL(-1\.[01])?": "cddl",
    r"Artistic(-[12]\.0(-Perl|-cl8)?)?": "artistic",
    r"BSL-1\.0": "bsl",
    r"OFL-1\.[01]": "ofl",
    r"AFL-[1-3]\.[0-2]": "afl",
    r"Python-2\.0|PSF-2\.0": "python",
    r"Unlicense": "unlicense",
    r"ISC": "isc",
    r"Zlib": "zlib",
    r"WTFPL": "wtfpl",
    r"PostgreSQL": "postgresql",
    r"NCSA": "ncsa",
    r"X11": "x11",
    r"curl": "curl",
}
EXCEPTIONS = (
    "Classpath-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "Autoconf-exception-2.0", "Autoconf-exception-3.0",
    "Bison-exception-2.2", "Bootloader-exception", "Font-exception-2.0", "OpenJDK-assembly-exception-1.0", "Qt-GPL-exception-1.0", "WxWindows-exception-3.1", "u-boot-exception-2.0",
)
KNOWN = re.compile("|".join(f"(?P<f{i}>{x})" for i, x in enumerate(IDENTIFIERS)), re.IGNORECASE)
OTHER = re.compile(r"(DocumentRef-[A-Za-z0-9.-]+:)?LicenseRef-[A-Za-z0-9.-]*[A-Za-z0-9]")
#: The form of a versioned identifier that is not known: a name, a version after a hyphen, and perhaps more parts.
VERSIONED = re.compile(r"[A-Za-z][A-Za-z0-9.]*(-[A-Za-z0-9.]+)*-v?\d+(\.\d+)*(-[A-Za-z0-9.]+)*\+?")
# Identifiers without a version that stand for themselves.
PLAIN = (
    "Abstyles AMDPLPA AML ANTLR-PD Bahyph Barr Beerware blessing Borceux Caldera ClArtistic CNRI-Jython Crossword CrystalStacker Cube diffmark DOC Dotseqn DSDP dvipdfm eGenix Entessa etalab Eurosym Fair FSFUL "
    "FSFULLR FTL GL2PS Glide Glulxe gnuplot HaskellReport HPND IJG ImageMagick Imlib2 Info-ZIP Intel Intel-ACPI JasPer-2.0 JPNIC JSON Latex2e Leptonica Libpng libtiff MakeIndex MirOS Mup NAIST-2003 Naumen "
    "Net-SNMP NetCDF Newsletr NGPL NLPL Noweb NPOSL-3.0 NTP Nunit OGTSL OML OpenSSL Plexus psfrag psutils Qhull Rdisc RSA-MD Ruby SAX-PD Saxpath SCEA Sendmail Sleepycat SMLNJ SNIA Spencer-86 SSH-OpenSSH SSH-short "
    "SWL TCL TCP-wrappers TMate TOSL TU-Berlin-1.0 Vim VOSTROM W3C Wsuipa Xerox xinetd Xnet xpp XSkat Zed zlib-acknowledgement"
)
UNVERSIONED = {x.lower() for x in PLAIN.split()}
#: What an expression is made of (an identifier ends before a full stop that ends a sentence), and the signs that end its line.
TOKEN = re.compile(rb"[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?|[()]|[\n\r*;\"'<]")
STOPS = set("\n\r*;\"'<")
COPYLEFT = ("gpl", "lgpl", "agpl", "mpl", "epl", "eupl", "cddl")
BINDS = {"or": 1, "and": 2, "with": 3}
LIFTING = {x.lower() for x in EXCEPTIONS}
FAMILIES = set(IDENTIFIERS.values())


def family(identifier: str) -> str | None:
    """The family of a known identifier; a LicenseRef-, and what has the form of an identifier, stand for themselves; None for other words."""
    if found := KNOWN.fullmatch(identifier):
        return next(f for i, f in enumerate(IDENTIFIERS.values()) if found[f"f{i}"] is not None)
    return identifier.lower() if OTHER.fullmatch(identifier) or VERSIONED.fullmatch(identifier) or identifier.lower() in UNVERSIONED else None


def is_permissive(name: str) -> bool | None:
    """Of a family; a LicenseRef- is no copyleft; None for identifiers that are only known by their form."""
    return name not in COPYLEFT if name in FAMILIES or "licenseref-" in name else None


def either(a: bool | None, b: bool | None) -> bool | None:
    return True if a or b else None if a is None or b is None else False


def both(a: bool | None, b: bool | None) -> bool | None:
    return False if a is False or b is False else None if a is None or b is None else True


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: 'with' binds more than 'and', 'and' more than 'or', all to the left. None if it is no expression."""
    out, held, operand = [], [], True
    for t in tokens:
        low = t.lower()
        if low in BINDS:
            if operand:
                return None
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif t == "(":
            if not operand:
                return None
            held.append(t)
        elif t == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool | None]:
    """The families named, and whether a permissive choice exists (any side of 'or', both of 'and'; a known exception lifts copyleft; None: not known)."""
    held: list[tuple[set[str], bool | None]] = []
    for t in postfix:
        if t in BINDS:
            (b, pb), (a, pa_) = held.pop(), held.pop()
            held.append((a, True) if t == "with" else (a | b, either(pa_, pb) if t == "or" else both(pa_, pb)))
        elif t.lower() in LIFTING:
            held.append((set(), True))
        else:
            held.append(({family(t)}, is_permissive(family(t))))
    return held[0]


def expression(raw: bytes, start: int = 0) -> tuple[set[str], bool | None] | None:
    """The longest licence expression that the line begins with, from the byte ``start`` on; reading ends where none can follow.

    Operands are known identifiers, LicenseRef-, and words in the form of a versioned identifier; 'with' stands between one of them (no
    bracket) and a known exception. Other words, NONE and NOASSERTION end the expression.
    """
    tokens, whole, depth, operand = [], 0, 0, True
    for m in TOKEN.finditer(raw, start):
        t = m[0].decode()
        low = t.lower()
        if t in STOPS or operand != (t == "(" or t != ")" and low not in BINDS) or t == ")" and not depth:
            break
        after_with = bool(tokens) and tokens[-1].lower() == "with"
        if after_with != (low in LIFTING) or low == "with" and (tokens[-1] == ")" or tokens[-1].lower() in LIFTING):
            break
        if operand and t != "(" and not after_with and family(t) is None:
            break
        tokens.append(t)
        depth += (t == "(") - (t == ")")
        operand = t == "(" or low in BINDS
        if not operand and not depth:
            whole = len(tokens)
    return evaluate(to_postfix(tokens[:whole])) if whole else None


class Scanner:
    def __init__(self):
        known = {phrase(p): (len(p.split()), label, True) for p, label in BASE.items()}
        known |= {phrase(p): (len(p.split()), label, False) for p, label in NOTICES.items()}
        self.phrases = automaton(known | {phrase(TAG): (3, None, False)})

    def __call__(self, text: str) -> tuple:
        """(words, base places, first, last, base labels, labels, score, permissive choice of the expressions)."""
        flat, words = word_bytes(text)
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts, base, labels, tags, permissive, raw, places = [], set(), set(), 0, None, b"", []
        before = at = 0
        for end, (n, label, is_base) in self.phrases.iter(line):  # in the order of their ends
            before, at = before + line.count(" ", at, end), end
            index = before - n
            if is_base:
                starts.append(index)
                base.add(label)
            elif label:
                labels.add(label)
            else:
                if not raw:
                    raw, places = text.encode("utf-8", "surrogatepass"), [m.end() for m in re.finditer(rb"\S+", flat)]
                found = expression(raw, places[index + n - 1])
                if found:
                    tags += 1
                    labels |= found[0]
                    permissive = found[1] if tags == 1 else both(permissive, found[1])
        score = 1.0 - 0.5 ** len(starts) * 0.6 ** len(labels - base) * (0.1 if tags else 1.0)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, permissive)


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: ``keep``, word count, base places, labels, score, and the expressions' verdict.

    Words are runs of digits, letters and non-ASCII characters after A-Z are lowered. A null
    text counts as an empty one (no words, null places, empty labels, score 0); repeated rows
    are scanned and returned again; an empty table gives no rows; other columns are ignored.
    ``permissive`` is null without a tag's expression, which must stand on the tag's line, and where it
    depends on an identifier that is known by its form only; of
    several tags all must be permissive. ``score`` is one minus the chance that none of the
    finds means a licence, taking a base phrase for wrong in one case of two, the label of a
    notice in six of ten, and a tag with an expression in one of ten. Very long texts are read
    whole. No shuffle.
    """

    def build():
        scan = Scanner()
        return lambda texts: [scan(t) for t in texts]

    return map_texts(docs, keep, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean", build)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents, whole; see ``scan_licenses`` for nulls, empty and long texts, and repeated rows. Other columns are ignored."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))
