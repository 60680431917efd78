"""Top-level declarations of brace languages and Ruby: where each begins and ends, its type and its name.

A text is masked (strings, comments and character literals become blanks), cut into its top-level statements by brackets,
line ends and semicolons, and each statement is classed by what it begins with. Types are named as syntax trees of these
languages commonly name them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Node:
    """A declaration with the 1-based lines it covers; members are the declarations in its body."""

    kind: str
    name: str | None
    start: int
    end: int
    members: list[Node] = field(default_factory=list)


_line_comment, _block_comment = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_double, _single = r'"(?:[^"\\\n]|\\.)*+"?', r"'(?:[^'\\\n]|\\.)*+'?"
_mask = {
    "script": re.compile(
        rf"{_line_comment}|{_block_comment}|`(?:[^`\\]|\\.)*+`?|{_double}|{_single}|(?<=[=(,:;!&|?\[{{}}\n])[ \t]*/(?![*/ ])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])*+/[a-z]*", re.S
    ),
    "java": re.compile(rf'{_line_comment}|{_block_comment}|"""(?:[^"\\]|\\.|"(?!""))*+"""|{_double}|{_single}', re.S),
    "go": re.compile(rf"{_line_comment}|{_block_comment}|`[^`]*+`?|{_double}|{_single}", re.S),
    "rust": re.compile(rf"{_line_comment}|{_block_comment}|r#*\"[^\"]*+\"#*|\"(?:[^\"\\]|\\.)*+\"?|'(?:[^'\\\n]|\\.)'", re.S),
    "c": re.compile(rf"{_line_comment}|{_block_comment}|{_double}|{_single}|^[ \t]*#(?:[^\n\\]|\\.)*+", re.S | re.M),
    "ruby": re.compile(rf"(?:^|(?<=\s))#[^\n]*|^=begin.*?^=end[^\n]*|{_double}|{_single}", re.S | re.M),
}
_annotated = r"(?:@(?!interface\b)[\w.]+\s*(?:\((?:[^()]|\([^()]*\))*+\))?\s*)*"


def _forms(*forms: tuple[str, str | None]) -> list[tuple[re.Pattern, str | None]]:
    return [(re.compile(pattern, re.S), kind) for pattern, kind in forms]


_java_mods = _annotated + r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp|synchronized|native|default|transient|volatile|async|override|virtual|internal|partial|readonly|unsafe|extern|new)\s+" + _annotated + ")*"
_type = r"(?:[\w.]+(?:\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)?(?:\s*\[\s*\])*\??)"
_classes = _forms(
    (_java_mods + r"class\s+(?P<name>\w+)", "class_declaration"), (_java_mods + r"interface\s+(?P<name>\w+)", "interface_declaration"),
    (_java_mods + r"(?:enum|record|struct|@interface|delegate)\s+(?P<name>\w+)", None),
)
_methods = _forms(
    (_java_mods + r"(?P<name>[A-Z]\w*)\s*\(", "constructor_declaration"), (_java_mods + rf"(?:<[^{{}};()]*>\s*)?{_type}\s+(?P<name>\w+)\s*(?:<[^<>]*>)?\s*\(", "method_declaration"),
)
_c_function = r"(?!(?:if|for|while|switch|else|do|return|typedef|struct|class|enum|union|namespace|using|extern\s*\" *C)\b)(?:template\s*<[^{};]*>\s*)?(?:[\w:<>,*&\[\]~]+\s+)*[*&\s]*(?P<name>~?\w+(?:::~?\w+)*)\s*\([^;{}]*\)[^;{}()=]*(?:\([^()]*\)[^;{}()]*)*(?=\{)"

#: Of each language its mask, the forms of top-level statements and those of the members of a class body.
LANGUAGES: dict[str, tuple[str, list, list]] = {
    "javascript": (
        "script",
        _forms(
            (r"export\b(?:\s+default)?\s+(?:async\s+)?(?:function\s*\*?|class)\s+(?P<name>[\w$]+)", "export_statement"), (r"export\b", "export_statement"), (r"(?:async\s+)?function\s+(?P<name>[\w$]+)", "function_declaration"),
            (r"class\s+(?P<name>[\w$]+)", "class_declaration"), (r"(?:const|let)\s+(?P<name>[\w$]+)", "lexical_declaration"),
        ),
        _forms((r"(?:(?:static|async|get|set)\s+|\*\s*)*(?P<name>[#\w$]+)\s*\(", "method_definition")),
    ),
    "typescript": (
        "script",
        _forms(
            (_annotated + r"export\b(?:\s+default)?(?:\s+declare)?(?:\s+abstract)?\s+(?:async\s+)?(?:function\s*\*?|class|interface|type|enum)\s+(?P<name>[\w$]+)", "export_statement"), (r"export\b", "export_statement"),
            (r"(?:async\s+)?function\s+(?P<name>[\w$]+)", "function_declaration"), (_annotated + r"class\s+(?P<name>[\w$]+)", "class_declaration"), (r"interface\s+(?P<name>[\w$]+)", "interface_declaration"), (r"type\s+(?P<name>[\w$]+)[^=;]*=", "type_alias_declaration"),
        ),
        _forms((_annotated + r"(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+|\*\s*)*(?P<name>[#\w$]+)\s*(?:<[^()]*>)?\s*\(", "method_definition")),
    ),
    "java": ("java", _classes, _classes + _methods),
    "c_sharp": ("java", _forms((r"namespace\s+(?P<name>[\w.]+)", "namespace_declaration")) + _classes, _classes + _methods),
    "go": (
        "go",
        _forms((r"func\s*\([^()]*\)\s*(?P<name>\w+)", "method_declaration"), (r"func\s+(?P<name>\w+)", "function_declaration"), (r"type\s+\(?\s*(?P<name>\w+)", "type_declaration"), (r"var\s+\(?\s*(?P<name>\w+)", "var_declaration")),
        [],
    ),
    "rust": (
        "rust",
        _forms(
            (r"(?:pub(?:\([^()]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*fn\s+(?P<name>\w+)", "function_item"), (r"(?:unsafe\s+)?impl\b", "impl_item"), (r"(?:pub(?:\([^()]*\))?\s+)?struct\s+(?P<name>\w+)", "struct_item"),
            (r"(?:pub(?:\([^()]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)", "trait_item"), (r"(?:pub(?:\([^()]*\))?\s+)?enum\s+(?P<name>\w+)", "enum_item"), (r"(?:pub(?:\([^()]*\))?\s+)?mod\s+(?P<name>\w+)", "mod_item"),
        ),
        _forms((r"(?:pub(?:\([^()]*\))?\s+)?(?:(?:const|async|unsafe)\s+)*fn\s+(?P<name>\w+)", "function_item")),
    ),
    "c": ("c", _forms((r"struct\s+(?P<name>\w+)\s*(?=\{)", "struct_specifier"), (_c_function, "function_definition"), (r"(?:typedef|using|namespace|template|enum|union|extern)\b", None), (r"[A-Za-z_][\w\s*,\[\]=().&\-+]*?(?P<name>\w+)\s*(?:\[|=|;|\()", "declaration")), []),
    "cpp": (
        "c",
        _forms((r"(?:inline\s+)?namespace\s+(?P<name>\w+)", "namespace_definition"), (r"(?:template\s*<[^{};]*>\s*)?class\s+(?P<name>\w+)[^;(]*(?=\{)", "class_specifier"), (_c_function, "function_definition"), (r"(?:typedef|using|template|enum|union|struct|extern)\b", None), (r"[A-Za-z_][\w:<>\s*,\[\]=().&\-+]*?(?P<name>\w+)\s*(?:\[|=|;|\()", "declaration")),
        _forms((r"(?:inline\s+)?namespace\s+(?P<name>\w+)", "namespace_definition"), (r"class\s+(?P<name>\w+)[^;(]*(?=\{)", "class_specifier"), (_c_function, "function_definition")),
    ),
}
LANGUAGES["tsx"] = LANGUAGES["typescript"]
_blocks = {"function_declaration", "class_declaration", "interface_declaration", "method_declaration", "constructor_declaration", "method_definition", "function_item", "impl_item", "trait_item", "namespace_declaration", "namespace_definition", "function_definition"}
_edge = re.compile(r"[()\[\]{};\n]")
_goes_on = re.compile(r"\s*(?:[.?:,=+\-*/%&|^<>)\]}]|(?:instanceof|in|of|as|extends|implements|where|else|catch|finally|while)\b)")
_unfinished = re.compile(r"(?:[=+\-*/%&|^<>,.?:(\[{]|=>|\b(?:return|extends|implements|of|in|new|const|let|var|export|default|async|function|class|from))\s*\Z")


def masked(language: str, text: str) -> str:
    """The text with the characters of strings and comments blanked, line ends kept."""
    return _mask[LANGUAGES[language][0]].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(text: str, at: int, stop: int, block: bool, lines_end: bool) -> tuple[int, int]:
    """Where the statement at this place ends, and where its body's bracket opens (-1 for none)."""
    depth, opened = 0, -1
    for m in _edge.finditer(text, at, stop):
        char, here = m[0], m.start()
        if char in "([{":
            if char == "{" and depth == 0 and opened < 0:
                opened = here
            depth += 1
        elif char in ")]}":
            depth -= 1
            if depth < 0:
                return here, -1
            if depth == 0 and char == "}" and block:
                return here + 1, opened
        elif depth == 0 and char == ";":
            return here + 1, opened
        elif depth == 0 and char == "\n" and lines_end and not block:
            if not _unfinished.search(text, max(at, here - 80), here) and not _goes_on.match(text, here):
                return here, opened
    return stop, opened


def _statements(language: str, text: str, at: int, stop: int, forms: list, deep: list, starts: list[int]) -> list[Node]:
    found = []
    lines_end = language in ("javascript", "typescript", "tsx", "go")
    while at < stop:
        if text[at].isspace() or text[at] in ";)]}":
            at += 1
            continue
        kind = name = None
        matched = False
        for pattern, own in forms:
            if m := pattern.match(text, at, stop):
                kind, name, matched = own, m.groupdict().get("name"), True
                break
        inner = re.match(r"export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|enum|namespace)\b", text[at : at + 80])
        block = kind in _blocks or matched and kind is None or bool(inner) or kind in ("struct_item", "enum_item", "mod_item", "struct_specifier", "class_specifier") or (kind == "export_statement" and text[at] == "@") or not lines_end and not matched
        end, opened = _end(text, at, stop, block, lines_end)
        if language == "c_sharp" and kind == "namespace_declaration" and opened >= 0:
            found.append(_node(kind, name, at, end, starts, _statements(language, text, opened + 1, end - 1, deep, deep, starts)))
        elif kind and end > at:
            members = _statements(language, text, opened + 1, end - 1, deep, deep, starts) if deep and opened >= 0 else []
            found.append(_node(kind, name, at, end, starts, members))
        at = max(end, at + 1)
    return found


def _node(kind: str, name: str | None, at: int, end: int, starts: list[int], members: list[Node]) -> Node:
    return Node(kind, name, bisect_right(starts, at), bisect_right(starts, end - 1), members)


_ruby = re.compile(r"^([ \t]*)(?:def\s+(?P<self>self\.)?(?P<method>[\w?!=]+)|(?P<kind>class|module)\s+(?P<name>[\w:]+))", re.M)


def _ruby_nodes(text: str, starts: list[int]) -> list[Node]:
    """Each def, class or module ends at the first end of its column."""
    top: list[Node] = []
    for m in _ruby.finditer(text):
        column = m[1]
        stop = re.compile(rf"^{re.escape(column)}end\b", re.M).search(text, m.end())
        if not stop:
            continue
        kind = m["kind"] or ("singleton_method" if m["self"] else "method")
        node = _node(kind, m["name"] or m["method"], m.end(1), stop.end(), starts, [])
        holder = top
        while holder and holder[-1].end >= node.end:
            holder = holder[-1].members
        holder.append(node)
    return top


def declarations(language: str, text: str) -> list[Node]:
    """Top-level declarations in order; none for languages that have no grammar here."""
    if language not in LANGUAGES and language != "ruby":
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    if language == "ruby":
        return _ruby_nodes(_mask["ruby"].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text), starts)
    _, forms, deep = LANGUAGES[language]
    body = masked(language, text)
    return _statements(language, body, 0, len(body), forms, deep, starts)
