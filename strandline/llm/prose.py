"""The prose of commit messages: what people wrote, without headers, trailers, code and stock lines."""

from __future__ import annotations

import re
import unicodedata

#: Lines of a commit's header.
_HEADER = re.compile(
    r"(?:commit|From) [0-9a-f]{7,40}\b.*|(?:Author|AuthorDate|Commit|CommitDate|Committer|Date|Merge|From|To|Cc|Message-Id|In-Reply-To|Reply-To|tree|parent):.*"
    r"|(?:author|committer|date|commit|email|parent)=.*",
)
_SUBJECT = re.compile(r"(?:Subject|subject|message|Message|title):\s*|(?:subject|message|title)=\s*")
#: Trailers, by form or by name.
_TRAILER = re.compile(r"[A-Z][A-Za-z]*(?:-[A-Za-z]+)+:(?:\s.*)?|(?:Refs?|Fixes|Closes|Resolves|Bug|Issue|Link|Ticket|See|Cc|Conflicts):(?:\s.*)?")
#: Stock lines of bots, merges, reverts and vendor imports.
_STOCK = re.compile(
    r"merge (?:branch|tag|remote-tracking branch|pull request|commit|remote|changes?|upstream|master|main|develop)\b.*|merged? in .*|merged (?:pr|branch)\b.*"
    r"|revert(?:ed)? [\"'“].*|reapply [\"'“].*|this reverts commit\b.*|this reapplies commit\b.*|\(?cherry[- ]picked from commit\b.*|(?:fixup|squash|amend)! .*|squashed commit of.*"
    r"|(?:[a-z]+\([^)]*\)!?: *|[a-z]+!?: *)?bump \S+(?: \S+)? from \S+ to \S+.*|bump version\b.*|(?:automatic|automated|auto)[- ](?:version bump|commit|merge|update|release|generated)\b.*|auto-?commit\b.*|version bump\b.*"
    r"|.*\[(?:skip ci|ci skip|bot|no ci|automated)\].*|build #?\d+\b.*|release v?\d[\w.]*|v?\d+\.\d+[\w.]*|update (?:lock ?file|dependency|dependencies|submodules?)\b.*"
    r"|(?:vendor|third[_-]party|deps)(?:\([^)]*\))?: *(?:import|update|sync|bump|add|upgrade)\b.*|(?:import|update|sync) (?:vendor|vendored|third[- ]party)\b.*|import vendor\b.*|initial commit\.?",
    re.I,
)
#: Marks before the subject proper.
_PREFIX = re.compile(
    r"(?:\[[^\]\n]{0,40}\]\s*|\(?#\d+\)?:?\s+|[A-Z]{2,10}-\d+:?\s+|(?:feat|fix|docs?|style|refactor|perf|tests?|build|ci|chore|revert|vendor|deps|wip|hotfix|bugfix)(?:\([^)\n]*\))?!?:\s*)+", re.I
)
_MARKER = re.compile(r"(?:[>|+\-*•#;%/\"]+\s+|//+\s*|/\*+\s*|\d+[.)]\s+)+")
#: Starts only where a run starts and gives nothing back, so that long runs cost linear time.
_IDENTIFIER = re.compile(
    r"`[^`\n]*`|https?://\S+"
    r"|(?<![!-~])[!-~]*[\d_/\\@#=<>{}\[\]|~^$%*+&][!-~]*"  # tokens with digits or marks of code
    r"|(?<![\w-])[\w-]++\([^()\n]*\)|(?<![\w-])[A-Za-z][\w-]*+\.[a-z]{1,6}\b(?!\s*[A-Z])|\b[a-z]++[A-Z]\w*|\b[A-Z][a-z]++[A-Z]\w*|(?<!\w)--?[a-z][\w-]*"
)
_CJK = "⺀-〇々〡-〩㐀-䶿一-鿿豈-﫿぀-ヿㇰ-ㇿｦ-ﾟ가-힯"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+(?:['’ʼ-][^\W\d_{_CJK}]+)*|[.!?…。！？:;]+(?=\s|$|[{_CJK}])|[。！？]")
_CJK_CHAR = re.compile(f"[{_CJK}]")
_DIFF = re.compile(r"^(?:diff --git |Index: |--- a/|GIT binary patch)", re.M)
_NEXT = re.compile(r"^(?:commit|From) [0-9a-f]{40}\b", re.M)
_FENCE = re.compile(r"(?:```|~~~)")


def is_unspaced(word: str) -> bool:
    """Whether this is one letter of a script without blanks."""
    return len(word) == 1 and word > "\u2e7f" and _CJK_CHAR.match(word) is not None


def messages(text: str) -> str:
    """The text without its diffs; what follows a later commit header is message again."""
    out, at = [], 0
    while found := _DIFF.search(text, at):
        out.append(text[at : found.start()])
        after = _NEXT.search(text, found.end())
        if not after:
            return "\n".join(out)
        at = after.start()
    out.append(text[at:])
    return "\n".join(out)


def _is_code(line: str) -> bool:
    letters = sum(map(str.isalpha, line))
    return letters * 2 < len(line.replace(" ", "")) or line[-1] in "{};" and any(c in line for c in "=()") or "==" in line or " = " in line


def prose(text: str | None) -> str:
    """The message's prose as lower-case words between blanks, sentences between line breaks.

    Letters of scripts without blanks stand alone.  '' where a message has no prose: at least two
    different words, or four letters of such a script.
    """
    if not text:
        return ""
    sentences: list[str] = []
    fenced = False
    for line in messages(text).splitlines():
        line = line.strip(" \t\r\n﻿​\xa0")
        if not line:
            continue
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or _HEADER.fullmatch(line):
            continue
        if found := _SUBJECT.match(line):
            line = line[found.end() :]
        if _TRAILER.fullmatch(line) or _STOCK.fullmatch(line):
            continue
        if found := _PREFIX.match(line):
            line = line[found.end() :]
            if _STOCK.fullmatch(line):
                continue
        if found := _MARKER.match(line):
            line = line[found.end() :]
        if not line:
            continue
        line = unicodedata.normalize("NFKC", line)
        clean = _IDENTIFIER.sub(" ", line)
        if not clean or clean.isspace() or _is_code(line):
            continue
        tokens = _TOKEN.findall(clean)
        if sum(t[0].isalpha() for t in tokens) < 2:
            continue
        sentence: list[str] = []
        for token in tokens:
            if token[0].isalpha():
                sentence.append(token.lower())
            elif sentence:
                sentences.append(" ".join(sentence))
                sentence = []
        if sentence:
            sentences.append(" ".join(sentence))
    flat = "\n".join(sentences)
    words = set(flat.split())
    if len(words) < 2 or all(map(_CJK_CHAR.match, words)) and len(flat.split()) < 4:
        return ""
    return flat
