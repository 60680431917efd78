"""Problem 2: source files that are no valid text of their language, by minimum-cost syntax repair.

Each file is lexed to token classes and parsed by an error-correcting chart (see chart); a repair cost above 0 flags the
file. Where the edits lie tells the cause: marker lines of a merge, brackets or literals still open at the end, tokens
that the language doesn't have throughout. Indented languages add the chart of their line structure. For Python and JSON,
whose parsers are at hand, flagged files are parsed once more and those that prove valid are dropped; nothing is added.

Defined results: null, empty and blank contents and other languages are no cases; a null language is read off the file
name; repeated rows of a file count once; the whole text is read; other columns are dropped.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chart import Chart, Phrases, Result

# fixed values: languages by the endings of file names
ENDINGS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript",
    "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "json": "json", "yaml": "yaml", "yml": "yaml", "sh": "bash", "bash": "bash",
}

_marker = r"^(?:<{7}|>{7}|\|{7})(?: [^\n]*)?$|^={7}\r?$"
_markers = re.compile(r"^<{7}(?: |$)|^>{7}(?: |$)|^={7}\r?$", re.M)
_name = r"[^\W\d]\w*"


class Classes(dict):
    """Token to class character; unknown tokens are classed by their first character."""

    def __init__(self, fixed: dict[str, str], word: str = "i"):
        super().__init__()
        self.fixed, self.word = fixed, word

    def __missing__(self, token: str) -> str:
        if len(self) > 400_000:
            self.clear()
        kind = self.fixed.get(token)
        if kind is None:
            kind = self.classify(token)
        self[token] = kind
        return kind

    def classify(self, token: str) -> str:
        first = token[0]
        if first.isalpha() or first in "_$" or first == "#" and len(token) > 1 and (token[1].isalpha() or token[1] == "_"):
            return self.word
        if first.isdigit() or first == "." and token[1:2].isdigit():
            return "n"
        if first == "." and len(token) > 1 or token.startswith(("?.", "::")) and len(token) > 2:
            return "q"
        if len(token) > 1 and first in "\"'`/":
            return "" if token.startswith(("//", "/*")) else "s"
        return "X"


def table(**groups: str) -> dict[str, str]:
    """class name _x=.. to {token: x}; values are space-separated tokens."""
    return {token: name[-1] for name, tokens in groups.items() for token in tokens.split()}


_COMMON = {"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", ",": ",", ";": ";", "\n": "N", "<": "<", ">": "g"}

# --- JavaScript and TypeScript ---------------------------------------------------------------------------------------

_js_lex = re.compile(
    _marker + r"|\A#![^\n]*|//[^\n]*|/\*[\s\S]*?\*/"
    r"|(?<=[=(,:;!&|?\[{}>\n])[ \t]*/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*|(?<=return)[ ]*/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
    r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
    r"|\.?\d[\w.]*(?:(?<=[eE])[+\-]\d+)?|\.\.\.|\??\.[$#]?[^\W\d][\w$]*|[$#]?[^\W\d][\w$]*|\$[\w$]*"
    r"|=>|[=!]==?|\*\*=?|\?\?=?|\?\.|\?\s*:|\?(?=\s*[,)=;])|\+\+|--|&&=?|\|\|=?|<<=?|<=|>=|[+\-*/%&|^]=|\n|[^\s]",
    re.M,
)
_js_fixed = _COMMON | table(
    _V="var let const", _F="function", _K="class", _I="import", _E="export", _D="default", _R="return throw", _G="if while for switch with catch",
    _L="else", _Y="try do finally", _U="typeof delete await new yield keyof", _O="in of instanceof as satisfies extends implements is", _J="break continue debugger", _A="case",
    _m="void get set static async public private protected readonly abstract declare override type interface enum namespace module from accessor",
    _o="* / % & | ^ ** && || ?? == != === !== <= >= <<", _p="+ -", _c="++ --", _h="=>",
) | {"=": "=", "+=": "=", "-=": "=", "*=": "=", "/=": "=", "%=": "=", "&=": "=", "|=": "=", "^=": "=", "**=": "=", "??=": "=", "&&=": "=", "||=": "=", "<<=": "=",
     "!": "!", "~": "!", "...": "!", "?": "?", ":": ":", ".": ".", "?.": ".", "@": "@"}
#: Words that only TypeScript knows; in a script they are names.
_ts_words = "private protected public readonly abstract declare override type interface enum namespace module accessor keyof satisfies implements is".split()
_js_atom = "([imnsPBCI]|F o?[im]?P{t}C|K[im]?(O T)*C|G)"
_js_step = "[!pcUm]*" + _js_atom + "[PBcsq!]*"
#: A colon belongs to a conditional, so none stands before the first question mark; with types it may stand anywhere.
_js_E = f"(([!pcUmoO]*{_js_atom}[PBcsq!]*)(([opOh.]|=o?){_js_step})*([?]{_js_step}(([opOh?.]|[=:]o?){_js_step})*)?)".replace("{t}", "")
_ts_E = f"(([!pcUmoO]*{_js_atom}[PBcsq!]*)(([opOh?.]|[=:]o?){_js_step})*)".replace("{t}", "(:T)?")
_ts_T = "[!pUmo]*[imnsPBC][PBq]*([oOh.?:]+[!pUm]*[imnsPBC][PBq]*)*"
_js_T = "[imnsPBC][PBq]*"


def _js(expression: str, typed: bool) -> str:
    expression = expression.replace("{E}", _ts_E if typed else _js_E).replace("{t}", "(:T)?" if typed else "")
    return expression.replace("T", f"({_ts_T if typed else _js_T})")


_js_decorated = "(@[im]q*P?)*"
_js_phrase = (
    f"{_js_decorated}(E? D?)("
    "{E}? | V {E} | {E} C(m s)? | E o (O[im])? m s | I s | I m? [imC] (m s)? | I m? o O [im] m s | C m s | o O [im] m s"
    "| (G P|G [Um] P|L|Y|[im]:|A {E}:|D:)+ ({E}|V {E}|R {E}?|J[im]?|C)? | G C? | Y P C"
    "| R {E}? | J [im]? | A {E} : ({E}|R {E}?|J|V {E})? | D : ({E}|R {E}?|J|V {E})? | [m!o]* [imnsBUGFKIEDRLYJAOV] [!?]? P {t} C? | [UGFKIEDRLYJAOV] : {E} | K [im]? (O T)* C | m [ims] q* (O T)* C | [imqsn]* (O T)* C"
    "| [im] : (G P C?|G P? {E}|Y C){more}"
    ")"
)
#: Members of an interface: a name, a call or an index, with its type.
_ts_members = _js("m*[imnsBUGFKIEDRLYJAOVM]?[!?]?P?(:T)?|U P(:T)?|B(:T)?", True)


def _js_chart_of(typed: bool) -> Chart:
    more = "| m* M [im] q* (O T)* C" if typed else "| [imnsB] : {E}"
    if not typed:
        phrase = _js_phrase.replace("(O[im])?", "(a[im])?").replace("o O [im]", "o a [im]").replace(" | m [ims] q* (O T)* C | [imqsn]* (O T)* C", " | [ims] C | [imqsn] | [imsD] a [imsD]").replace("{more}", more)
    else:
        phrase = _js_phrase.replace("{more}", more)
    phrase = _js(phrase, typed)
    paren = _js(f"{_js_decorated}({{E}} | V {{E}} | V [BC] | V {{E}} O {{E}} )", typed)
    phrases = {"{": Phrases(phrase), "top": Phrases(phrase), "(": Phrases(paren), "[": Phrases(_js(f"{_js_decorated}({{E}})", typed))}
    if not typed:
        return Chart(phrases, joiners=".,;N?:=ohpPBqcOs!")
    phrases["{i"] = Phrases(_ts_members)
    inside = re.compile(r"M[im]q*(?:O[^{]*)?$").search
    return Chart(phrases, joiners=".,;N?:=ohpPBqcOs!", kinds=lambda bracket, before: "{i" if bracket == "{" and inside(before) else bracket)


_js_chart, _ts_chart = _js_chart_of(False), _js_chart_of(True)
_js_drop = re.compile(r"(?<=[(\[{,;NopO=h?:.!UmFKEIVA@<])N+|N+(?=[)\]},;NopO=h?:.q)LY\]g])|^N+")
_ts_args = re.compile(r"(?<=[imqM])<[imnsqoOUpB.,?:()\[\]hN!C]*g(?=[^imn]|[imq]?$|m)|<[im,O=NqT.\[\]o()]*g(?=\()|(?<=m)<[imO,]*g")
_ts_braced = re.compile(r"(?<=[imq])<[imnsqoOUp.,?:()\[\]hN!{};]*g(?=[({)\],;=\[N|o}])")


def _script(text: str, typed: bool) -> Result:
    kinds = _ts_classes if typed else _js_classes
    tokens = "".join([kinds[t] for t in _js_lex.findall(text)])
    if "N" in tokens:
        tokens = _js_drop.sub("", tokens)
    if typed and "<" in tokens:
        before = None
        while before != tokens:
            before, tokens = tokens, _ts_args.sub("", tokens)
        tokens = _ts_braced.sub("", tokens)
    if "<" in tokens or "g" in tokens:
        tokens = re.sub("[<g]+", "o", tokens)
    return (_ts_chart if typed else _js_chart).parse(tokens)


class _ScriptClasses(Classes):
    def classify(self, token: str) -> str:
        if token[0] == "?" and token[-1] == ":":
            return ":"
        stripped = token.lstrip(" \t")
        if stripped != token and stripped[:1] == "/":
            return "s"
        if token.startswith("#!"):
            return ""
        if token[0] == "?" and len(token) == 1:
            return "?"
        return super().classify(token)


_ts_classes = _ScriptClasses(_js_fixed | {"interface": "M"})
_js_classes = _ScriptClasses({k: v for k, v in _js_fixed.items() if k not in _ts_words} | {"as": "a"})

# --- Java ------------------------------------------------------------------------------------------------------------

_java_lex = re.compile(
    _marker + r"|//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.[0-7a-fA-Fu]*)'"
    r"|\d[\w.]*(?:(?<=[eE])[+\-]\d+)?|\.\d\w*|\.\.\.|(?:\.|::)\s*[^\W\d][\w$]*|[^\W\d][\w$]*|\$\w*|->|[=!]=|<=|\+\+|--|&&|\|\||<<=?|[+\-*/%&|^]=|[^\s]",
    re.M,
)
_java_fixed = _COMMON | table(
    _m="public private protected static final abstract native transient volatile strictfp sealed default synchronized", _K="class interface enum record", _O="extends implements throws permits",
    _I="import package", _G="if while for switch catch", _L="else", _Y="try do finally", _R="return throw assert yield", _J="break continue", _A="case", _N="new",
    _o="* / % & | ^ && || == != <= <<", _p="+ -", _c="++ --", _h="->", _v="instanceof",
) | {"=": "=", "+=": "=", "-=": "=", "*=": "=", "/=": "=", "%=": "=", "&=": "=", "|=": "=", "^=": "=", "<<=": "=", "!": "!", "~": "!", "?": "?", ":": ":", "@": "@", "...": "~", ".*": "q", "\n": ""}
_java_E = "([!pcNPm]*([insPCB]|GPC)[PBcqC]*)(v[m]?iq*B*[iP]?|[op=h?:][!pcNP]*([insPCB]|GPC)[PBcqC]*)*"
_java_mods = "(m|@iq*P?)*"
_java_phrase = (
    f"{_java_mods}(E0? | iq*B*~?i B*(=E0)? | iq*B* i P B*(O iq*)? C? | i P (O iq*)? C? | K i P? (O iq*)* C? | @ K i C | iq* (O iq*)* C | O iq* (O iq*)* C? | I m? iq*(q|.o)? | C"
    "| G P? S? | L S? | L G P S? | Y P? C? | Y S | m P C? | R E0? | J i? | A E0 (h(S|C)|:S?)? | m h (S|C) | m : S? | i : G P C?)"
)
_java_S = f"(E0|{_java_mods}iq*B* i(=E0)?|R E0?|J i?|C|G P C?|G P (E0|R E0?|J i?))"


def _java_expression(text: str) -> str:
    return text.replace("S?", f"({_java_S})?").replace("(S|C)", f"({_java_S}|C)").replace("Y S", f"Y ({_java_S})").replace("E0", f"({_java_E})")


_java_record = f"{_java_mods}(E0 | iq*B*~?i B*(=E0)? | iq*B*i:E0 | iq*(o iq*)* i | i:E0)"
_java_phrases = {k: Phrases(_java_expression(_java_phrase)) for k in ("{", "top")}
_java_phrases |= {"(": Phrases(_java_expression(_java_record)), "[": Phrases(_java_expression("E0"))}
_java_phrases |= {"{b": _java_phrases["{"], "{k": _java_phrases["{"]}


def _java_kind(bracket: str, before: str) -> str:
    """Bodies of statements, whose last one must end; of classes and enums, where it must if any does; array values."""
    if bracket != "{" or before[-1:] not in ("P", "i", "L", "Y", "h", "q"):
        return bracket
    return "{k" if "K" in before else "{b"


_java_chart = Chart(_java_phrases, separators=",;", joiners=".,;?:=ohpq", kinds=_java_kind, ended={"{b": True, "{k": False})
_java_args = re.compile(r"(?<=[imqN@])<[iqm,?O.o@\[\]]*g|(?<=m)<[iqO,o]*g")
_java_classes = Classes(_java_fixed)


def _java(text: str) -> Result:
    kinds = _java_classes
    tokens = "".join([kinds[t] for t in _java_lex.findall(text)])
    if "<" in tokens:
        before = None
        while before != tokens:
            before, tokens = tokens, _java_args.sub("", tokens)
    if "<" in tokens or "g" in tokens:
        tokens = re.sub("[<g]+=?", "o", tokens)
    return _java_chart.parse(tokens.replace(".o", "q"))


_java_classes.fixed["."] = "."

# --- Go --------------------------------------------------------------------------------------------------------------

_go_lex = re.compile(
    _marker + r"|//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'"
    r"|\d[\w.]*(?:(?<=[eE])[+\-]\d+)?|\.\d\w*|\.\.\.|\.\s*[^\W\d]\w*|[^\W\d]\w*|:=|<-|[=!<>]=|\+\+|--|&&|\|\||&\^=?|<<=?|>>=?|[+\-*/%&|^]=|\n|[^\s]",
    re.M,
)
_go_fixed = {k: v for k, v in _COMMON.items() if k not in "<>"} | table(
    _I="package import", _F="func", _K="type", _V="var const", _G="if for switch select", _L="else", _R="return", _W="go defer", _J="break continue goto fallthrough", _A="case", _D="default",
    _M="map chan struct interface", _U="range", _o="/ % | ^ && || == != <= >= << >> < > &^", _k="* &", _p="+ - <-", _c="++ --",
) | {"=": "=", ":=": "=", "+=": "=", "-=": "=", "*=": "=", "/=": "=", "%=": "=", "&=": "=", "|=": "=", "^=": "=", "<<=": "=", ">>=": "=", "&^=": "=", "!": "!", ":": ":", ".": ".", "...": "~", "~": "k"}
_go_T = "([pkBM~]*([iP]q*B?|M C|F P ([pkBM~]*[iP]q*B?)?))"
_go_E = "([!pk~UBM]*([insPBC]|F P T?C?|M C)[PBqcC~]*)([opk=:.][!pk~UBM]*([insPBC]|F P T?C?|M C)[PBqcC~]*)*"
_go_S = "(E0|R E0?|W E0|J i?|C|V E0)"
_go_atom = "([insPB]|F P T?C?|B[kB]*iq*C|M[Bk]*iq*C|M C)[PBqc~]*"
_go_H = f"([!pk~UBM]*{_go_atom})([opk=:.][!pk~UBM]*{_go_atom})*"
_go_phrase = (
    "E0? | I s | I P | I [i.] s? | s | [i.] s | K i B? =? T s? | K P | V i T? (=E0)? | V P | F P? i B? P T? C? | F P? i B? P T? | G (H0|V H0)? C? | G i? =? U E0 | L S? | L G E0? C?"
    "| R E0? | W E0 | J i? | A (E0|U E0) (:S?)? | E0 : S? | D : S? | i T s? | i q* s | k i q* s? | i P T? | T s? | K"
)


def _go_expression(text: str) -> str:
    return text.replace("S?", f"({_go_S})?").replace("E0", f"({_go_E})").replace("H0", f"({_go_H})").replace("T", _go_T)


_go_phrases = {k: Phrases(_go_expression(_go_phrase)) for k in ("{", "top")}
_go_phrases |= {"(": Phrases(_go_expression("E0 | i T | T | I? s | i s | [i.] s | i T? = E0 | i T? | K | i B? T s? ")), "[": Phrases(_go_expression("E0 | i T | E0? : E0? | T"))}
_go_chart = Chart(_go_phrases, joiners=".,;N:=opkPBqc")
_go_classes = Classes(_go_fixed)
_go_drop = re.compile(r"(?<![insPBCqcJRK)\]}N])N+|N+(?=[)\]}])|^N+")


def _go(text: str) -> Result:
    kinds = _go_classes
    tokens = "".join([kinds[t] for t in _go_lex.findall(text)])
    return _go_chart.parse(_go_drop.sub("", tokens))


# --- JSON ------------------------------------------------------------------------------------------------------------

_json_lex = re.compile(r"\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+\-]?\d+)?(?![\w.])|true|false|null|[^ \t\r\n]")
_json_classes = Classes({"true": "n", "false": "n", "null": "n", ":": ":", ",": ",", "[": "[", "]": "]", "{": "{", "}": "}"}, word="X")
_json_value = "[snBC]"
_json_chart = Chart({"{": Phrases(f"s:{_json_value}"), "[": Phrases(_json_value), "top": Phrases(_json_value), "(": Phrases("Z")}, separators=",", after_block="\0")


def _json(text: str) -> Result:
    kinds = _json_classes
    tokens = "".join([kinds[t] if t[0] != "-" or len(t) == 1 else "n" for t in _json_lex.findall(text)])
    out = _json_chart.parse(tokens)
    empty = len(re.findall(r"[\[{,],|,[\]}]|,$|^,", tokens))
    out.cost += empty + (not tokens)
    # at the top only one value
    depth = re.sub(r"[^\[\]{},]", "", tokens)
    level = 0
    for char in depth:
        level += (char in "[{") - (char in "]}")
        if char == "," and level == 0:
            out.cost += 1
    return out


# --- Python ----------------------------------------------------------------------------------------------------------

_py_prefix = r"(?:[rRbBuUfFtT]{0,2})"
_py_lex = re.compile(
    _marker + rf"|#[^\n]*|{_py_prefix}\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|{_py_prefix}'''(?:[^\\]|\\[\s\S])*?'''|{_py_prefix}\"(?:[^\"\\\n]|\\[\s\S])*\"|{_py_prefix}'(?:[^'\\\n]|\\[\s\S])*'"
    r"|\d[\w.]*(?:(?<=[eE])[+\-]\d\w*)?|\.\d\w*(?:(?<=[eE])[+\-]\d\w*)?|\.\.\.|\.\s*[^\W\d]\w*|[^\W\d]\w*|\\\r?\n|:=|->|==|!=|<=|>=|\*\*=?|//=?|<<=?|>>=?|[+\-*/%&|^@]=|\n[ \t]*|[^\s]",
    re.M,
)
_py_fixed = {k: v for k, v in _COMMON.items() if k not in "<>"} | table(
    _F="def", _K="class", _I="import", _J="pass break continue", _R="return raise assert del global nonlocal", _U="not lambda await yield", _o="and or in is if else for / % & | ^ // << >> == != <= >= < > as",
    _k="* @", _j="**", _p="+ - ~", _h="->", _y="async", _f="from",
) | {"=": "=", ":=": "=", "+=": "=", "-=": "=", "*=": "=", "/=": "=", "%=": "=", "&=": "=", "|=": "=", "^=": "=", "**=": "=", "//=": "=", "<<=": "=", ">>=": "=", "@=": "=", ":": ":", ".": ".", "...": "n"}


_py_digits = r"\d(?:_?\d)*"
_py_number = re.compile(
    rf"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|[1-9](?:_?\d)*|0(?:_?0)*|{_py_digits}\.(?:{_py_digits})?(?:[eE][+\-]?{_py_digits})?[jJ]?"
    rf"|\.{_py_digits}(?:[eE][+\-]?{_py_digits})?[jJ]?|{_py_digits}[eE][+\-]?{_py_digits}[jJ]?|{_py_digits}[jJ]"
)


class _PythonClasses(Classes):
    def classify(self, token: str) -> str:
        if token[0] == "#" or token[0] == "\\":
            return ""
        if token[0] == "\n":
            return "N"
        if token[-1] in "\"'" and len(token) > 1:
            return "s"
        if token[0].isdigit() or token[0] == "." and token[1:2].isdigit():
            return "n" if _py_number.fullmatch(token) else "X"
        return super().classify(token)


def _py(expression: str) -> str:
    """One star and two stars (j) are told apart in arguments only."""
    out, inside = [], False
    for char in expression:
        inside = char == "[" or inside and char != "]"
        out.append({True: "kj", False: "[kj]"}[inside] if char == "k" else char)
    return "".join(out)


#: A value: only strings stand beside strings.
_py_A = "([inPBC][PBq]*|s+[PBq]*)"
_py_E = f"([pUkf]*{_py_A}([opk=:Uf]+[pUkof]*{_py_A})*)"
_py_list = f"([pUkf]*{_py_A}([opk=:Uf,]+[pUkof]*{_py_A})*,?)"
#: The same without assignments, and what can be assigned to.
_py_plain = f"[pUkf]*{_py_A}([opk:Uf,]+[pUkof]*{_py_A})*,?"
#: (behind a lambda its defaults are assigned)
_py_value = f"({_py_plain}|({_py_plain}[opk:f,]*)?U[pUkof:]*({_py_list})?)"
_py_target = "(k?(i|P|B|[inPBC][PBq]*[Bq]|s+[PBq]*[Bq]))"
_py_targets = f"({_py_target}(,{_py_target})*,?)"
_py_S = (
    f"({_py_value}|{_py_targets}(={_py_targets})*=y?({_py_value}|f{_py_value})|{_py_target}:{_py_value}(=y?{_py_value})?|R ({_py_value})?|R {_py_value} f {_py_value}|R {_py_value} o? U? {_py_value}|J"
    f"|I i q*(o i)?(,i q*(o i)?)*|I k|I P|f [.n]* [iq]* q* I ([iPk](o i)?)(,i(o i)?)*|U ({_py_value})?|y {_py_value}|k {_py_value}|f {_py_value})"
)
_py_header = f"i (E0)|y? F i B? P (h E0)?|K i B? P?|y? G k? (E0 (o E0)?)?|Q k? ({_py_E} (o i)?)?|L"
_py_phrase = f"S | ({_py_header}) : S? | G [PBq]* =E0 | k E0 | i i B? = E0"
_py_phrase = _py_phrase.replace("S?", f"({_py_S})?").replace("S |", f"({_py_S}) |").replace("E0", f"({_py_list})")
_py_inside = "(E0|[kp]*E0|:|E0?:E0?|E0 f? y?|k|E0:E0?:E0?|:E0|E0:|::E0|G E0|E0 (y|o|G)* E0|G (E0)? : (E0)?|L E0|E0 (G E0|L E0)*|U?:E0|U: E0|U k* i|U[i=np]*)"
_py_inside = _py_inside.replace("E0", f"({_py_E})")
_py_phrases = {"top": Phrases(_py(_py_phrase)), "(": Phrases(_py(_py_inside + "|(y?)")), "[": Phrases(_py(_py_inside)), "{": Phrases(_py(_py_inside))}
_py_phrases["(d"] = Phrases(_py(_py_inside + "|o"))
_py_default, _py_keyword = re.compile(r"i(?::[^=]*)?=").match, re.compile(r"i=").match


def _py_order(kind: str, pieces: list[str]) -> int:
    """Arguments out of order: a parameter without default behind one with, a plain argument behind a named one."""
    wrong = named = 0
    for piece in pieces:
        if kind == "(d":
            if piece[0] in "kj":
                named = 0
            elif _py_default(piece):
                named = 1
            elif named and piece[0] == "i":
                wrong += 1
        elif kind == "(":
            if piece[0] == "j":
                named = 2
            elif _py_keyword(piece):
                named = max(named, 1)
            elif named == 2 or named and piece[0] != "k":
                wrong += 1
    return wrong


_py_chart = Chart(
    _py_phrases, separators=",;N", after_block="\0", top=";", order=_py_order,
    kinds=lambda bracket, before: "(d" if bracket == "(" and re.search(r"FiB?$", before) else bracket,
)
_py_classes = _PythonClasses(_py_fixed)
_py_first = table(_G="if elif while for with", _Q="except", _L="else try finally")


def _python(text: str) -> Result:
    """The chart of each logical line, and of the lines' indentation."""
    kinds = _py_classes
    words = _py_lex.findall("\n" + text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿"))
    out = Result(tokens=len(words))
    levels = [0]
    opened = False
    line: list[str] = []
    depth, indent = 0, 0

    def close() -> None:
        nonlocal opened
        tokens = "".join(line)
        line.clear()
        if not tokens:
            return
        if opened:
            if indent > levels[-1]:
                levels.append(indent)
            else:
                out.cost += 1
        else:
            while len(levels) > 1 and indent < levels[-1]:
                levels.pop()
            if indent != levels[-1]:
                out.cost += 1
        found = _py_line(tokens)
        out.cost += found.cost
        out.open = found.open
        out.foreign += found.foreign
        opened = tokens[-1] == ":"

    for word in words:
        if word[0] == "\n" and depth <= 0:
            close()
            depth = 0
            indent = len(word[1:].expandtabs(8))
            continue
        kind = kinds[word]
        if kind == "N":
            continue
        if not line or line == ["y"]:
            kind = _py_first.get(word, kind)
        if kind in ("(", "[", "{"):
            depth += 1
        elif kind in (")", "]", "}"):
            depth -= 1
        line.append(kind)
    close()
    if opened:
        out.cost += 1
        out.open += 1
    return out


_py_lines: dict[str, Result] = {}


def _py_line(tokens: str) -> Result:
    found = _py_lines.get(tokens)
    if found is None:
        if len(_py_lines) > 200_000:
            _py_lines.clear()
        found = _py_lines[tokens] = _py_chart.parse(tokens)
    return found


# --- Bash ------------------------------------------------------------------------------------------------------------

_heredoc = re.compile(r"<<-?[ \t]*(['\"]?)([A-Za-z_]\w*)\1([^\n]*)\n(?:[\s\S]*?\n)??[ \t]*\2[ \t]*(?=\r?\n|\Z)")
_bash_nested = r"(?:[^()]|\((?:[^()]|\([^()]*\))*+\))*+"
_bash_lex = re.compile(
    _marker + rf"|(?:^|(?<=[\s;]))#[^\n]*|\\[\s\S]|(?<=\$)'(?:[^'\\]|\\[\s\S])*+'|\$?'[^']*'|\"(?:[^\"\\$`]|\\[\s\S]|\$\({_bash_nested}\)|\$|`[^`]*`)*+\"|`[^`]*`"
    rf"|\$\(\({_bash_nested}\)\)|\(\({_bash_nested}\)\)|\$\{{(?:[^{{}}]|\{{[^{{}}]*\}})*+\}}|\[\[ [^\n]*? \]\](?=[\s;&|)]|$)"
    r"|;;&?|;&|&&|\|\||\|&|&>>?|\n|[;&|(){}]|<\(|>\(|\$\(|<<<|[0-9]*[<>]+&?-?|(?:[^\s;&|(){}\"'`\\<>$#]|\$(?![({])|(?<=\S)#)+|[^\s]",
    re.M,
)
#: Reserved words by class: if then elif else fi, for and select, while and until, do done, case in esac, function, ! and time.
_bash_reserved = {
    "if": "I", "then": "T", "elif": "E", "else": "L", "fi": "i", "for": "F", "select": "F", "while": "W", "until": "W", "do": "D", "done": "d",
    "case": "K", "esac": "k", "function": "U", "!": "z", "time": "z",
}
_bash_simple = {"\n": "N", ";": ";", "&": ";", "&&": "O", "||": "O", "|": "O", "|&": "O", ";;": "e", ";&": "e", ";;&": "e"}
_assignment = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")
_bash_first = set("NO;e({TELDWIpz") | {"$"}


def _bash_tokens(text: str) -> tuple[str, int]:
    """Classes of the tokens, and how many quotes are open. A shell's words are reserved by where they stand, so the lexer
    keeps track of that: at the start of a command, in a for or case header, in a case pattern."""
    while True:
        text, n = _heredoc.subn(r"\3", text)
        if not n:
            break
    out: list[str] = []
    cases: list[str] = []  # of each open case: header, pattern or list
    depths: list[int] = []  # brackets open inside it
    start, header, quotes = True, "", 0
    wordy = False  # the token before is a word, which this one may go on with
    end = -1
    pattern_open = False
    for m in _bash_lex.finditer(text):
        word = m[0]
        glued, end, wordy = wordy and m.start() == end, m.end(), False
        if word[0] == "#" and len(word) > 1:
            continue
        if word[0] == "\\":
            if word[1:2] in ("\n", "\r", ""):
                end = -1
                continue
            word = "w"
        if len(word) > 6 and _markers.match(word) or len(word) == 1 and (word in "\"'`" or ord(word) < 32 and word != "\n" or word == "\x7f"):
            quotes += word in "\"'`"
            out.append("X")
            start = False
            continue
        if cases and cases[-1] == "pattern" and not depths[-1]:
            # a pattern ends with its bracket; so does the case, at its word
            if word == "esac" and not pattern_open:
                cases.pop()
                depths.pop()
                out.append("k")
                start = False
            elif word == ")":
                out.append("p")
                cases[-1], start, pattern_open = "list", True, False
            elif word == "\n":
                if not pattern_open:
                    out.append("N")
            elif word == "(" and not pattern_open:
                pattern_open = True
            elif word in _bash_simple and word != "|":
                out.append("X")
            else:
                pattern_open = True
            continue
        if word in _bash_simple:
            kind = _bash_simple[word]
            if kind == "e" and cases and not depths[-1]:
                cases[-1] = "pattern"
                pattern_open = False
            out.append(kind)
            start = True
            header = header if kind == "N" and header else ""
            continue
        if word in ("(", "{", "$(", "<(", ">("):
            if word == "{" and (glued or not start and out[-1:] not in (["Q"], [")"]) and header != "function"):
                start, wordy = False, True
                out.append("w") if not glued else None
                continue
            if word == "(" and out[-1:] == ["a"] and glued:
                out.append("[")
            else:
                out.append("$" if word in ("$(", "<(", ">(") else word)
            if cases:
                depths[-1] += 1
            if out[-1] == "[":
                # an array: words up to the bracket
                start = False
                cases.append("array")
                depths.append(0)
            else:
                start = True
            header = ""
            continue
        if word in (")", "}"):
            if word == "}" and (glued or not start):
                start, wordy = False, True
                continue
            if word == ")" and cases and cases[-1] == "array" and not depths[-1]:
                cases.pop()
                depths.pop()
                out.append("]")
            else:
                out.append(word)
            if cases:
                depths[-1] -= 1
            start, wordy = False, word == ")"
            continue
        if word[0] in "<>" or word[0].isdigit() and word[-1] in "<>&-" and ("<" in word or ">" in word) or word.startswith("&>"):
            # with a number for its target in the same token nothing follows
            out.append("s" if word.endswith("-") else "r")
            continue
        wordy = True
        if glued:
            continue
        if start and word in _bash_reserved:
            kind = _bash_reserved[word]
            out.append(kind)
            start = kind in "ITELWDz"
            if kind == "K":
                cases.append("header")
                depths.append(0)
            elif kind == "k" and cases and cases[-1] == "list":
                cases.pop()
                depths.pop()
            header = {"F": "for", "U": "function"}.get(kind, "")
            continue
        if cases and cases[-1] == "header" and not depths[-1] and word == "in":
            out.append("n")
            cases[-1], pattern_open = "pattern", False
            continue
        if header == "for" and word == "in":
            out.append("n")
            header = ""
            continue
        if header == "for" and word == "do":
            out.append("D")
            start, header = True, ""
            continue
        if word.startswith(("((", "[[ ")) and start:
            out.append("h")
            # a loop's header may be followed by do at once
            start = out[-2:-1] == ["F"]
            header = ""
            continue
        if start and _assignment.match(word) and out[-1:] != ["r"]:
            out.append("a")
            continue
        out.append("w")
        start = False
    return "".join(out), quotes


# A command's phrases; M is a compound command that is closed, Y a do list, P a subshell, Q empty brackets, A an array.
_bash_redirect = "(s|r[wV])*"
_bash_word = "([wV]|aA?|r[wVP]|s|A)"
_bash_compound = f"(M|P|h|F [wh] N* (n [wV]*)? [;N]* Y|F h Y){_bash_redirect}"
_bash_command = f"z*({_bash_word}+|{_bash_compound}|[wV] Q N* (M|P|h){_bash_redirect}|U [wV] Q? N* (M|P|h){_bash_redirect}|z)"
_bash_chain = f"{_bash_command}(O N* {_bash_command})*"
#: Lists in which loops are closed already (condition, do list: one symbol), and those of a loop's condition.
_bash_list = f"N*({_bash_chain}([;N] N* {_bash_chain})* [;N]? N*)"
_bash_phrases = {
    "top": Phrases(f"(N*|{_bash_list})"), "{": Phrases(_bash_list), "(": Phrases(f"(N*|{_bash_list})"), "$": Phrases(f"(N*|{_bash_list})"), "D": Phrases(_bash_list), "[": Phrases("[wVaN]*"),
    "W": Phrases(f"{_bash_list} Y"), "I": Phrases(f"{_bash_list} T {_bash_list} (E {_bash_list} T {_bash_list})* (L {_bash_list})?"), "K": Phrases(f"[wV] N* n N* (p (N*|{_bash_list}) e N*)* (p (N*|{_bash_list}))?"),
}
_bash_pairs = {"{": "}", "(": ")", "$": ")", "I": "i", "K": "k", "D": "d", "[": "]"}
_bash_symbols = {"{": "M", "(": "P", "(0": "Q", "$": "V", "I": "M", "K": "M", "D": "Y", "[": "A"}


class _BashChart(Chart):
    """A while or until and what lies before its do list is a cell of its own, closed as the list is."""

    def _parse(self, kind: str, content: str) -> int:
        cost = 0
        while (at := content.rfind("W")) >= 0 and kind != "W":
            stop = content.find("Y", at)
            if stop < 0:
                stop = len(content) - 1
            cost += self.cell("W", content[at + 1 : stop + 1])
            content = content[:at] + "M" + content[stop + 1 :]
        return cost + self.phrases[kind].cost(content)


_bash_chart = _BashChart(_bash_phrases, whole=tuple(_bash_phrases), pairs=_bash_pairs, symbols=_bash_symbols)


def _bash(text: str) -> Result:
    tokens, quotes = _bash_tokens(text.replace("\r\n", "\n"))
    out = _bash_chart.parse(tokens)
    out.open += quotes
    return out


# --- YAML ------------------------------------------------------------------------------------------------------------

_yaml_key = re.compile(r"(?:\"(?:[^\"\\]|\\.)*+\"|'(?:[^']|'')*+'|\?|[^\s#&*!|>'\"%@`\[\]{},\-?:][^#]*?|[&*!][^\s]+(?: [^\s:]+)?|[\-?:][^\s#][^#]*?)\s*:(?=\s|$)")
_control = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_yaml_flow = re.compile(
    r"\"(?:[^\"\\]|\\[\s\S])*+\"|'(?:[^']|'')*+'|[\[\]{},\"']|:(?=[\s,\[\]{}]|$)|(?<=\")\s*:|(?:^|(?<=\s))#[^\n]*|\s+"
    r"|(?:[^\s\[\]{},:#\"']|:(?![\s,\[\]{}]|$))(?:[^\s\[\]{},:#]|(?<=\S)#|:(?![\s,\[\]{}]|$))*+|.", re.S
)
_yaml_item = "s*[sBC]?"
_yaml_flow_chart = Chart(
    {"{": Phrases(f"(s+|[sBC]*:|s*[BC]?:{_yaml_item}|s+:{_yaml_item})"), "[": Phrases(f"(s+|s*[BC]|s*[BC]?:{_yaml_item})"), "top": Phrases("[BC]"), "(": Phrases("Z")}, separators=",", after_block="\0"
)
#: A block: entries of a mapping (m with its value on the line, o without; C is the block below), of a sequence (e, f), or
#: a scalar. A sequence may stand at the column of the key that it is the value of. X is a line that fits no column.
_yaml_sequence = "(e C?|f C?)+"
_yaml_block = f"((mS?|oC?|o{_yaml_sequence})+|{_yaml_sequence}|sS?)"
_yaml_chart = Chart(
    {"{": Phrases(_yaml_block), "top": Phrases(f"(D*({_yaml_block}(D+{_yaml_block})*D*)?)"), "(": Phrases("Z"), "[": Phrases("Z")}, whole=("{", "top"), pairs={"{": "}"}, symbols={"{": "C"}
)


def _flow(text: str) -> tuple[int, int, int]:
    """Cost of the flow value or quoted scalar at the start of a text, where it ends, and how much of it is left open."""
    out, depth, last = [], 0, ""
    for m in _yaml_flow.finditer(text):
        token = m[0]
        if token.isspace() or token[0] == "#" and (m.start() == 0 or text[m.start() - 1].isspace()):
            continue
        if len(token) == 1 and token in "\"'":
            return 1, len(text), 1
        if token in ("[", "{"):
            depth += 1
        elif token in ("]", "}"):
            depth -= 1
        kind = token if token in ("[", "]", "{", "}", ",") else ":" if token.strip() == ":" else "s"
        empty = kind == "," and last in ("[", "{", ",", "")
        if not (kind == "s" and last == "s"):
            out.append("X" if empty else kind)
        last = kind
        if depth <= 0 and not (depth == 0 and kind == "s" and len(out) > 1):
            if kind == "s" and len(out) == 1:
                return 0, m.end(), 0
            return _yaml_flow_chart.parse("".join(out)).cost, m.end(), 0
    found = _yaml_flow_chart.parse("".join(out))
    return found.cost, len(text), found.open


def _yaml(text: str) -> Result:
    """The chart of a text's block structure: a deeper column opens a cell, a column of an open cell closes those inside."""
    lines = re.split(r"\r\n|\n|\r", text.lstrip("﻿"))
    bad = len(_control.findall(text))
    tokens: list[str] = []
    cost = left_open = 0
    levels: list[int] = []  # columns of the open cells
    at, count = 0, len(lines)
    scalar = False  # the last value may go on in deeper lines

    def close(to: int) -> None:
        while levels and levels[-1] > to:
            levels.pop()
            if levels:
                tokens.append("}")

    while at < count:
        line = lines[at]
        at += 1
        body = line.strip()
        if not body or body[0] == "#":
            continue
        if re.match(r"(?:---|\.\.\.)(?:\s|$)", line) or line.startswith("%"):
            close(-1)
            tokens.append("D")
            scalar = False
            rest = line[3:].strip()
            if line.startswith("---") and rest and rest[0] not in "#|>&!":
                line = "   " + line[3:]
            else:
                continue
        column = len(line) - len(line.lstrip(" "))
        if line[column : column + 2] in ("? ", ": "):
            # a key and its value on lines of their own count as one entry, by its key
            if line[column] == ":":
                continue
            line = line[:column] + "key: " + line[column + 2 :]
        if line[column] == "\t" or _markers.match(line):
            tokens.append("X")
            continue
        rest = line[column:]
        item = rest[0] == "-" and (len(rest) == 1 or rest[1] in " \t")
        key = None if item else _yaml_key.match(rest)
        if not item and not key and scalar and levels and column > levels[-1]:
            # a plain scalar goes on; a mapping cannot begin in it
            if re.search(r":\s|:$", rest):
                tokens.append("X")
            continue
        if levels and column < levels[-1]:
            close(column)
            if not levels or levels[-1] != column:
                tokens.append("X")
                levels.append(column) if not levels else None
        if not levels:
            levels.append(column)
        elif column > levels[-1]:
            levels.append(column)
            tokens.append("{")
        value = rest
        while True:
            item = rest[0] == "-" and (len(rest) == 1 or rest[1] in " \t")
            key = None if item else _yaml_key.match(rest)
            if item:
                inner = rest[1:].strip()
                gap = len(rest[1:]) - len(rest[1:].lstrip(" "))
                if not inner or inner[0] == "#":
                    tokens.append("f")
                    value = ""
                    break
                rest = rest[1 + gap :]
                column += 1 + gap
                if _yaml_key.match(rest) or rest[0] == "-" and rest[1:2] in (" ", ""):
                    tokens += ["f", "{"]
                    levels.append(column)
                    continue
                tokens.append("e")
                value = rest
            elif key:
                value = rest[key.end() :].strip()
                tokens.append("m")
            else:
                value = rest
                tokens.append("s")
            break
        bare = re.sub(r"^(?:[&!][^\s]*\s*)+", "", value)
        scalar = False
        if not bare or bare[0] == "#":
            if tokens[-1] in "me":
                tokens[-1] = {"m": "o", "e": "f"}[tokens[-1]]
            continue
        if bare[0] in "|>":
            if not re.fullmatch(r"[|>][+\-\d]*\s*(?:#.*)?", bare):
                cost += 1
            base = levels[-1] if tokens[-1] != "s" else -1
            while at < count and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > base):
                at += 1
            continue
        if bare[0] in "\"'[{":
            whole = bare
            found, end, opened = _flow(whole)
            while opened and at < count:
                whole += "\n" + lines[at].strip()
                at += 1
                found, end, opened = _flow(whole)
            cost += found
            left_open += opened
            behind = whole[end:].strip()
            if behind and not behind.startswith("#") and not (tokens[-1] == "s" and behind.startswith(":")):
                cost += 1
            continue
        if bare[0] in "@`%,]}":
            cost += 1
            continue
        if bare[0] != "*":
            if re.search(r":(?:\s|$)", re.sub(r"\s#.*$", "", bare)):
                cost += 1
            scalar = True
    close(-1)
    out = _yaml_chart.parse("".join(tokens))
    out.tokens = max(count, 1)
    out.cost += cost + bad
    out.foreign += bad
    out.open = left_open
    return out


PARSERS = {
    "python": _python, "javascript": lambda text: _script(text, False), "typescript": lambda text: _script(text, True),
    "java": _java, "go": _go, "json": _json, "yaml": _yaml, "bash": _bash,
}


def language_of(language: str | None, path: str | None) -> str | None:
    if language:
        return language.lower() if language.lower() in PARSERS else None
    name = (path or "").rsplit("/", 1)[-1].lower()
    return ENDINGS.get(name.rsplit(".", 1)[-1]) if "." in name else None


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON value")


def proved(language: str, content: str) -> bool:
    """Whether the language's own parser takes the text, where it is at hand."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(content, "file", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
            return True
        if language == "json":
            json.loads(content, parse_constant=_no_constant)
            return True
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        pass
    return False


def repair(language: str, content: str) -> tuple[int, str | None]:
    """Least repair cost of a text, and its cause: conflict, foreign, truncated or damaged."""
    found = PARSERS[language](content)
    if not found.cost or proved(language, content):
        return 0, None
    if _markers.search(content):
        return found.cost, "conflict"
    # edits throughout, by their share, whatever the text's length; one edit is no more than damage, and each of what is open
    # at the end may cost a few
    if found.cost > max(1, 4 * found.open) and found.cost > found.tokens * 0.08:
        return found.cost, "foreign"
    if found.open:
        return found.cost, "truncated"
    return found.cost, "damaged"


def check_files(df: DataFrame) -> DataFrame:
    """repo_id, relative_path, language, cost and cause of each file of a known language; cost 0 for valid ones."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, costs, causes, kept = [], [], [], []
            for path, language, content in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                own = language_of(language, path)
                kept.append(own is not None)
                cost, cause = repair(own, content) if own else (0, None)
                languages.append(own)
                costs.append(cost)
                causes.append(cause)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(costs, pa.int32()), pa.array(causes, pa.string())],
                ["repo_id", "relative_path", "language", "cost", "cause"],
            ).filter(pa.array(kept, pa.bool_()))

    rows = df.select(*(F.col(c).cast("string").alias(c) for c in ("repo_id", "relative_path", "language", "content")))
    return rows.where(F.col("content").rlike(r"\S")).mapInArrow(
        check, "repo_id string, relative_path string, language string, cost int, cause string"
    )


def invalid_files(checked: DataFrame) -> DataFrame:
    return checked.where("cost > 0").select("repo_id", "relative_path").distinct()


def rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language."""
    files = checked.groupBy("repo_id", "relative_path", "language").agg(F.max("cost").alias("cost"))
    return files.groupBy("repo_id", "language").agg(
        F.count("*").alias("files"), F.sum((F.col("cost") > 0).cast("bigint")).alias("invalid"), F.avg((F.col("cost") > 0).cast("double")).alias("rate")
    )
