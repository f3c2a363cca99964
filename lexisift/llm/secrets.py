"""Credentials embedded in source code and configuration: finding them and blanking them out in place.

Literal values, under any name, are weighed by their characters per subword under a public tokenizer: words of a language or of
programs take few subwords, keys and passwords many, and only values below ``UNNATURAL`` are taken. The context decides what
else is needed: under a name that says secret, that it is no placeholder, reference or path; under a name of a connection more;
known token formats,
URLs with a password and private-key blocks anywhere; under any other name, or none, an unnatural literal in which capitals,
small letters and digits mix as only chance does it. Digests, ids, certificates and public keys are never taken.

Redaction keeps every offset: each character of the value but line ends and quotes becomes ``x``, so the code around it, its
columns and its line numbers stay as they were.

Null text has no secrets and stays null; a text of any length is read whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters per subword below which a value is unnatural: prose has more than 4, identifiers about 3.
UNNATURAL = 2.7

#: Words that end a name that holds a secret (fixed values).
SECRET_WORDS = frozenset(
    "password passwd passphrase pass pwd pw secret token credential credentials cred creds apikey key seed kennwort passwort contrasena clave motdepasse mdp license pin salt auth authorization bearer".split()
)
#: Before a last word "key", "seed", "license" or "pin" any of these (or nothing else that says what it is) must stand.
_KEY_BEFORE = frozenset("api access secret private signing mapper encryption master service hook app client auth license session deploy storage account shared admin webhook".split())
CONNECTION_WORDS = frozenset("conn connection dsn remote login source endpoint url uri link host database db broker value".split())
NEVER_WORDS = frozenset("checksum digest sha sha1 sha256 sha512 md5 hash etag commit revision rev trace span integrity fingerprint cert certificate public font image version path".split())

_PLACEHOLDER = re.compile(
    r"""^(?:change[_-]?me.*|your[_-].*|<[^>]*>|\[[^\]]*\]|[xX]{3,}|\*{2,}|\.{2,}|-+|0+|1234(?:5678?9?0?)?|todo.*|tbd|fixme|replace[_-]?(?:me|this|with).*|dummy.*|example.*|sample.*|insert[_-].*|enter[_-].*|placeholder.*|redacted.*|masked|hidden|secret|password|passwd|token|none|null|nil|true|false|undefined|test|foo|bar|n/?a|empty|default|required|optional|string|str|bytes|\d{1,5}|.*\b(?:your|my)[_-](?:token|key|password|secret).*)$""",
    re.I,
)
_REFERENCE = re.compile(
    r"""^(?:\$\{?[\w.:-]+\}?.*|\$\(.*|%\(?\w+\)?s?%?|\{\{?.*\}?\}|env[:.].*|vault[:.].*|ssm[:.].*|arn:.*|secretsmanager.*|file:.*|kms[:.].*|@?Value.*|#\{.*|!(?:secret|vault|env).*|op://.*|keyring.*|(?:os|process|System|std)\.(?:env|getenv).*|.*\b(?:getenv|environ|read_secret|getpass|get_secret|vault\.read)\b.*)$""",
    re.I,
)
_UUID = re.compile(r"^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?$", re.I)
#: Formats of issued tokens (fixed values).
KNOWN = re.compile(
    r"(?<![\w/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{18,}|xox[abeoprs]-[\w-]{18,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[\w-]{24,}"
    r"|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|dop_v1_[0-9a-f]{40,}|hf_[A-Za-z0-9]{30,}|eyJ[\w-]{10,}\.eyJ[\w-]{8,}\.[\w-]{10,})(?![\w/+-])"
)
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@'\"`<>]*:([^\s/@'\"`]+)@[^\s'\"`<>]+", re.I)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END [A-Z0-9 ]*-----")
_BODY = re.compile(r"(?:[\s\"'`+,;\\]*[A-Za-z0-9+/=]{8,})*+")
_SCHEME = re.compile(r"\b(Bearer|Basic|Token|token)\s+([A-Za-z0-9._~+/=!^*<${}\[-][^\s'\"`;,)]{3,})")
#: What some rule needs in a line: the head of an issued token, a word of a name, or a phrase. It passes over only lines in which
#: no rule could fire; words that hold another of them are left out.
_HEADS = ("AKIA", "ASIA", "gh[pousr]_", "github_pat_", "glpat-", "xox", "[srp]k_(?:live|test)_", "sk-", "AIza", r"SG\.", "npm_", "pypi-", "dop_v1_", "hf_", "eyJ")
_WORDS_OF_NAMES = sorted(w for w in SECRET_WORDS | CONNECTION_WORDS if not any(x != w and x in w for x in SECRET_WORDS | CONNECTION_WORDS))
_GATE = re.compile("|".join((*_HEADS, *_WORDS_OF_NAMES, "basic", "://", "connect", r"identified\s", "sign_?in", r"(?:with|using)\s+`")), re.I)
_STRING = r"(?P<q>\"\"\"|'''|[\"'`])(?P<v>(?:(?!(?P=q)).)*)"
#: A name, an assignment or separator, and what follows.
_ASSIGN = re.compile(
    r"""(?P<n>[A-Za-z_][\w.$-]*)["'`]?\s*\]?\s*(?P<op>:=|=>|==?|:(?:\s*[\w.\[\]]+\s*=)?|\)?\s*,(?=\s*["'`])|(?<=["'`])\s*>|>)\s*(?P<r>.*)""",
    re.S,
)
#: A value given with a user: login("svc", "x"), identified by 'x', sign in as `svc` with `x`.
_GIVEN = re.compile(
    r"""\b(?:\w*(?:login|connect|auth|credentials?|sign_?in)\w*\(\s*(?:(?P<p>["'`])[\w.@-]*(?P=p))\s*,\s*|identified\s+by\s+|password\s+(?=['"`])|(?:with|using|password|passphrase|token)\s+(?=`))(?P<q>["'`])(?P<v>[^"'`\s]{4,})(?P=q)""",
    re.I,
)
#: What may follow a name, in turn: a separator, the second of a pair, words at the end of a line, the value of a flag.
_AFTER = re.compile(r"""["'`]?\s*\]?\s*(?:(:=|=>|=(?!=)|:\s*(?:str|string|String|&str|const char\*?|Optional\[str\])\s*=|:(?![:/])|\s+(?:string|String)\s*=)\s*|(/?>)|\s+(value|content)\s*=\s*)""")
_PAIR = re.compile(r"""(["'`])\s*,\s*(?=["'`])""")
_SAID = re.compile(r"\s+(?:is\s+|was\s+|on \w+ is\s+|for \w+ is\s+|equals\s+)?([\"'`]?)([^\s\"'`]{4,})\1[.;,]?\s*(?:\*/|-->)?\s*$")
_FLAG = re.compile(r"[ =]([\"'`]?)([^\s\"'`]{3,})\1")
_SET = re.compile(r"[=#]")
_HERE = re.compile(r"<<-?\s*['\"]?([A-Za-z_]\w*)['\"]?")
_BARE = re.compile(r"[^\s\"'`]+")
_TAIL = re.compile(r"\s*(?:$|#|//|\*/|-->)")
_ENTRY = re.compile(r"""\bvalue["']?\s*[:=]\s*(["']?)([^"'\s,}]{6,})\1""", re.I)
_COLUMNS = re.compile(r"\(([^()]*)\)\s*values\s*(?=\()", re.I)
_SQL = re.compile(r"'(?:[^']|'')*+'|[(),;]")
_NAME = re.compile(r"[A-Za-z_][\w.-]*")
_MARK = re.compile(r"^\s*(?:#|//|/\*|\*|--|<!--|;|>)")


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(50_000)
def chars_per_subword(value: str, tokenizer: str = TOKENIZER) -> float:
    return len(value) / max(1, len(_encoder(tokenizer).encode_ordinary(value)))


def _words(name: str) -> list[str]:
    """The words of a name, lower case, without counters at its end."""
    name = name.rsplit(".", 1)[-1]
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    words = [p.lower() for p in parts if not p.isdigit()]
    while len(words) > 1 and len(words[-1]) == 1:
        words.pop()
    return words


@lru_cache(50_000)
def name_kind(name: str) -> str:
    """secret, connection, never or nothing."""
    w = _words(name)
    if not w:
        return ""
    if w[-1] in ("opts", "options", "map", "config", "default", "value") and len(w) > 1 and w[-2] in SECRET_WORDS:
        w = w[:-1]
    last = w[-1]
    if last in NEVER_WORDS or (len(w) > 1 and w[-2] in NEVER_WORDS and last in ("id", "ref", "value")):
        return "never"
    if last in SECRET_WORDS:
        if last in ("key", "pin", "salt", "pass", "token", "license", "seed", "auth") and len(w) == 1 and last in ("key", "pin", "salt"):
            return ""
        if last == "key" and not set(w[:-1]) & _KEY_BEFORE:
            return ""
        if "public" in w or "cert" in w:
            return "never"
        return "licence" if last in ("license", "seed") else "secret"
    if w[0] == "x" and "auth" in w or w[-1] == "code" and "pin" in w:
        return "secret"
    if last in CONNECTION_WORDS:
        return "connection"
    return ""


def natural(value: str) -> bool:
    """Words as people or programs write them: few subwords for their length."""
    return chars_per_subword(value) >= UNNATURAL


def dead(value: str) -> bool:
    """Nothing, a placeholder or a reference to where the secret is kept."""
    v = value.strip().strip("\"'`")
    v = re.sub(r"^(?:Bearer|Basic|Token)\s+", "", v)
    return len(v) < 4 or bool(_PLACEHOLDER.match(v)) or bool(_REFERENCE.match(v))


def live(value: str, kind: str) -> bool:
    v = value.strip()
    if dead(v) or kind == "never":
        return False
    if _BLOCK.match(v):
        return True
    if "-----BEGIN" in v or v.startswith(("ssh-rsa ", "ssh-ed25519 ", "sha1-", "sha256-", "sha384-", "sha512-", "sha256:")):
        return False
    if re.match(r"[a-z][a-z0-9+.-]*://", v, re.I):
        m = _URL.match(v)
        return bool(m) and not dead(m[1]) and not natural(m[1])
    if KNOWN.search(v):
        return True
    scheme = re.match(r"(Basic|Bearer|Token)\s+(\S+)$", v)
    if scheme:
        return not natural(scheme[2])
    if " " in v or "\t" in v:
        return False
    if kind in ("secret", "licence"):
        if _UUID.match(v):
            return True
        if kind == "licence" and (len(v) < 12 or chars_per_subword(v) >= UNNATURAL or re.match(r"(?:LicenseRef|Apache|MIT|BSD|L?GPL|AGPL|MPL|CC|EPL|ISC)[-.]", v)):
            return False
        return not natural(v) and not re.fullmatch(r"[\w.-]+\[[\w.='\"-]+\]|/[\w./-]*|[\w.-]+\.(?:pem|key|json|ya?ml|txt|env|crt)|[A-Z][a-z]*(?:-[A-Z][a-z]*)+", v)
    if kind == "connection":
        if re.fullmatch(r"[0-9a-f]{32,}", v):
            return True
        if _UUID.match(v) or chars_per_subword(v) >= 1.9 and re.fullmatch(r"\d+(?:[.:]\d+)*|[\w.-]+:\d+|[\w-]+(?:\.[\w-]+)+(?::\d+)?(?:/\S*)?|/\S*|[\w-]+(?:/[\w.-]+)+|[\w.-]+@[\w.-]+", v) and not re.search(r"[A-Z]\w*[.~!_=^+-][A-Z]?\w*\d{2,}|[=~!^+]", v):
            return False
        if not re.search(r"\d|[!~^=+]", v) or len(v) < 8 or re.search(r"[(){}\[\],;<>]", v):
            return False
        return chars_per_subword(v) < 3.2
    return False


#: Values of 16 to 512 characters, in quotes or bare behind a separator up to the end of the line, that mix three kinds of characters.
_MIXED = r"""(?=[^\s"'`]{0,511}[0-9])(?=[^\s"'`]{0,511}[A-Z])(?=[^\s"'`]{0,511}[a-z])(?P<v>[\w!@$%^&*+/=~.-]{16,512})"""
_WEIGHED = re.compile(rf"""(?P<q>["'`]){_MIXED}(?P=q)|(?:[:=]\s*){_MIXED.replace("<v>", "<w>")}(?=[;,]?[^\S\n]*$)""", re.M)
_BEFORE = re.compile(r"""([A-Za-z_][\w.-]*)["'`]?\s*\]?\s*(?::=|=>|[:=,(])\s*["'`]?$""")
#: Words beside a literal that say it is drawn by chance but no secret: ids, digests, data, alphabets.
_OTHER = NEVER_WORDS | frozenset("id ids uuid guid uid nonce sri sum data image icon svg png blob payload alphabet charset chars letters digits pattern regex re format sitekey sample example fixture mock expected want".split())


def chance(v: str) -> bool:
    """Whether a value, whatever its name, can only be drawn by chance: unnatural, mixed, and no digest, id, path or format."""
    if chars_per_subword(v) >= 2.0 or dead(v) or _UUID.match(v) or re.search(r"[A-Z]{3,}[a-z]{0,2}[0-9]*$", v) and "_" in v or re.search(r"0123|abcd|ABCD|(.)\1{3}", v):
        return False
    if v.startswith(("sha1-", "sha256-", "sha384-", "sha512-", "h1:", "iVBOR", "data:", "MII", "AAAA", "/", "./", "../", "http", "R0lGOD", "UEsDB", "H4sI")) or "%" in v or "$" in v or "//" in v:
        return False
    # of parts, one must be mixed by itself
    return any(len(x) >= 16 and re.search("[0-9]", x) and re.search("[A-Z]", x) and re.search("[a-z]", x) and len(re.findall(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])", x)) >= len(x) / 4 for x in re.split(r"[./=_-]", v))


class _Scan:
    def __init__(self, text: str, path: str = ""):
        self.text, self.path = text, (path or "").lower()
        self.hits: dict[int, tuple[int, int]] = {}
        self.bare = (0, 0)
        self.last_tag = text.rfind("<")

    def put(self, a: int, b: int) -> None:
        while a < b and self.text[a] in " \t\r\n":
            a += 1
        if a < b and not any(x < b and y > a for x, y in self.hits.values()):
            self.hits[a] = (a, b)

    def run(self) -> list[tuple[int, int]]:
        t = self.text
        for m in _BLOCK.finditer(t):
            end = _END.search(t, m.end())
            stop = end.end() if end else _BODY.match(t, m.end()).end()
            self.put(m.start(), stop)
        done = -1
        for m in _GATE.finditer(t):
            if m.start() < done:
                continue
            a = t.rfind("\n", 0, m.start()) + 1
            b = t.find("\n", m.start())
            b = len(t) if b < 0 else b
            done = b
            self._line(a, b)
        for m in _HERE.finditer(t):
            self._here_document(m)
        odd = [m.span("v" if m["v"] else "w") for m in _WEIGHED.finditer(t)]
        odd = [x for x in odd if chance(t[x[0] : x[1]])]
        # several in a row are the lines of a blob
        joined = [bool(re.fullmatch(r"[\s\"'`+,;.\\()\[\]]{0,200}", t[x[1] : y[0]])) for x, y in zip(odd, odd[1:])]
        for x, before, behind in zip(odd, [False, *joined], [*joined, False]):
            if not before and not behind:
                self._weigh(*x)
        return sorted(self.hits.values())

    def _weigh(self, a: int, b: int) -> None:
        """A literal that looks drawn by chance, under any name: what stands around it."""
        # base64 of more than 48 bytes, or a piece that nothing takes, is data
        if b - a > 64 and re.fullmatch(r"[A-Za-z0-9+/]+=*", self.text[a:b]) or not re.search(r"[\w\])>-]\s*[=:(,>]\s*[([{]*\s*[\"'`]?$|[\w\])]\s+[\"'`]$|[\"'`]\s*[:=,]\s*[\"'`]?$|^\s*return\s*[\"'`]$", self.text[max(0, a - 200) : a]):
            return
        name = _BEFORE.search(self.text[max(self.text.rfind("\n", 0, a) + 1, a - 120) : a])
        if name and set(_words(name[1])) & _OTHER:
            return
        if re.search(r"BEGIN (?!.*PRIVATE)|-----END", self.text[max(0, a - 80) : b + 80]):
            return
        self.put(a, b)

    def _formats(self, a: int, line: str) -> None:
        for m in KNOWN.finditer(line):
            self.put(a + m.start(), a + m.end())
        for m in _URL.finditer(line):
            if live(m[0], ""):
                self.put(a + m.start(), a + m.end())

    def _line(self, a: int, b: int) -> None:
        line = self.text[a:b]
        self._formats(a, line)
        for m in _SCHEME.finditer(line):
            if not dead(m[2]) and live(m[1].title() + " " + m[2].rstrip("\"'`"), "secret") and re.search(r"\d", m[2]):
                self.put(a + m.start(2), a + m.end(2))
        at = 0
        while m := _NAME.search(line, at):
            at = m.end()
            kind = name_kind(m[0])
            if kind in ("secret", "licence", "connection"):
                self._value(a, b, m, kind, line)
        lower = line.lower()
        for m in _ENTRY.finditer(line) if "value" in lower else ():
            at = a + m.start()  # of the same braces, or of this line and the two before it
            lo = a
            for _ in range(2):
                lo = self.text.rfind("\n", 0, max(lo - 1, 0)) + 1
            before = self.text[max(lo, self.text.rfind("{", lo, at)) : at]
            named = re.findall(r"""(?:name|key|id)["']?\s*[:=]\s*["']?([A-Za-z_][\w.-]*)""", before)
            if named and name_kind(named[-1]) == "secret" and live(m[2], "secret"):
                self.put(a + m.start(2), a + m.end(2))
        for m in _GIVEN.finditer(line):
            v = m["v"]
            if live(v, "secret"):
                self.put(a + m.start("v"), a + m.end("v"))
        if "values" in lower and "(" in line:
            self._sql(a, line)

    def _sql(self, a: int, line: str) -> None:
        for m in _COLUMNS.finditer(line):
            names = [x.strip().strip('"`[]') for x in m[1].split(",")]
            depth = k = 0
            begin = m.end()
            for x in _SQL.finditer(line, begin):  # rows of values, and what is nested in them
                c = x[0]
                if depth == 0 and (c not in "(," or line[begin : x.start()].strip()):
                    break
                if depth == 1 and c[0] == "'" and k < len(names) and not line[begin : x.start()].strip() and live(c[1:-1], name_kind(names[k])):
                    self.put(a + x.start() + 1, a + x.end() - 1)
                if c == "(":
                    depth += 1
                    k = k if depth > 1 else 0
                elif c == ")":
                    depth -= 1
                elif c == "," and depth == 1:
                    k += 1
                if depth == 0 or depth == 1 and c in "(,":
                    begin = x.end()

    def _back(self, p: int, a: int) -> int:
        """Before the white space that ends at p."""
        while p > a and self.text[p - 1].isspace():
            p -= 1
        return p

    def _value(self, a: int, b: int, name: re.Match, kind: str, line: str) -> None:
        """What stands behind a name: in quotes, bare, on the next line, in pieces, in a tag, in words."""
        t = self.text
        # lines can be long: everything is matched where it stands
        at, e = a + name.start(), a + name.end()
        # name = value, "name": value, name := value, name: type = value, <name>value, key="name">value, ("name", value)
        m = _AFTER.match(t, e, b)
        pair = None if m else _PAIR.match(t, e, b)
        if pair and at > a and t[at - 1] == pair[1] and (p := self._back(at - 1, a)) > a and t[p - 1] in "([{":
            self._literal(pair.end(), b, kind, line)
            return
        if m:
            start = m.end()
            if m[2]:
                if m[2] == "/>" or t.endswith("</", a, self._back(at, a)):
                    return
                end = t.find("<", start) if start <= self.last_tag else -1
                if end >= 0 and live(t[start:end], kind):
                    self.put(start, start + len(t[start:end].rstrip()))
                return
            self._literal(start, b, kind, line)
            return
        if kind not in ("secret", "licence"):
            return
        # --password 'x', password x
        flag = t.endswith("--", a, at)
        m = (_FLAG if flag else _SAID).match(t, e, b)
        if m and (flag or _MARK.match(line) or _SET.search(t, e, b) is None):
            v = m[2].rstrip(".,;") if not flag else m[2]
            odd = re.search(r"\d", v) or re.search(r"[!~^=+_]", v)
            if live(v, "secret") and (flag or (odd and ("_" in name[0] or re.search(r"[a-z][A-Z]", name[0]) or _MARK.match(line)) and (_MARK.match(line)))):
                self.put(m.start(2), m.start(2) + len(v))

    def _here_document(self, m: re.Match) -> None:
        """A here-document behind a token with a name that says secret."""
        t = self.text
        stop = self._back(m.start(), 0)
        begin = stop
        while begin > 0 and not t[begin - 1].isspace() and t[begin - 1] != "<":
            begin -= 1
        if any(name_kind(x[0]) in ("secret", "licence") for x in _NAME.finditer(t, begin, stop)):
            line = t.find("\n", m.end())
            end = re.compile(rf"^\s*{m[1]}\s*$", re.M).search(t, line) if line >= 0 else None
            if end and live(t[line + 1 : end.start()].strip().split("\n")[0], "secret"):
                self.put(line + 1, end.start())

    def _literal(self, start: int, b: int, kind: str, line: str) -> None:
        t = self.text
        s = start
        while s < len(t) and t[s] in " \t\r\n([{" and (t[s] != "\n" or not t[start:b].strip(" \t\r([{")):
            s += 1
        if s >= len(t):
            return
        if s > b and not t[start:b].strip() and t[s] not in "\"'`":
            return  # the next line is another statement
        head = re.match(r"(?:[rbuf]{1,2})?(\"\"\"|'''|[\"'`])", t[s : s + 6])
        if head:
            q = head[1]
            at = s + head.end()
            end = self._close(at, q)
            if end < 0:
                return
            pieces = [(at, end)]
            pos = end + len(q)
            while m := re.compile(r"\s*(?:\+|\.|\\|&|\|\|)?\s*([\"'`])").match(t, pos):  # cut into pieces
                if "\n" not in m[0] and not re.search(r"[+.&|\\]", m[0]):
                    break
                if "\n" in m[0] and not re.search(r"[+.&|\\]", m[0]) and not re.search(r"\(\s*$", t[start:s]):
                    break
                close = self._close(m.end(), m[1])
                if close < 0:
                    break
                pieces.append((m.end(), close))
                pos = close + 1
            value = "".join(t[x:y] for x, y in pieces)
            if live(value, kind):
                self.put(pieces[0][0], pieces[-1][1])
            return
        block = re.match(r"[|>][+-]?\s*\n", t[s : s + 8])
        if block:
            nxt = s + block.end()
            end = t.find("\n", nxt)
            v = t[nxt : end if end >= 0 else len(t)]
            if live(v.strip(), kind):
                self.put(nxt, nxt + len(v.rstrip()))
            return
        config = re.search(r"(?:\.env(?:\.\w+)?|\.ya?ml|\.sh|dockerfile|\.toml|\.ini|\.cfg|\.properties|\.conf|\.md|\.txt)$", self.path) or _MARK.match(line) or not self.path
        if not config:
            return
        if not self.bare[0] <= s < self.bare[1]:  # names inside a long run share its end
            bare = _BARE.match(t, s, b)
            self.bare = (s, bare.end()) if bare else (s, s)
        end = self.bare[1]
        if not s < end:
            return
        v = t[s:end].rstrip(";,")
        if (not _TAIL.match(t, end, b) and not re.match(r"^\s*(?:export|ENV|ARG)\b", line)):
            return
        if re.search(r"[(){}\[\]<>]|^[A-Za-z_][\w.]*$(?<!\d)", v) and not re.search(r"\d", v):
            return
        if live(v, kind):
            self.put(s, s + len(v))

    def _close(self, at: int, q: str) -> int:
        t = self.text
        while True:
            end = t.find(q, at)
            if end < 0 and t.find("\n", at) < 0:
                return len(t)  # the text is an excerpt, or damaged, and ends inside the literal
            if end < 0 or (len(q) == 1 and q != "`" and t.find("\n", at, end) >= 0):
                return -1
            back = 0
            while t[end - 1 - back] == "\\":
                back += 1
            if back % 2 == 0:
                return end
            at = end + 1


def find(text: str | None, path: str | None = "") -> list[tuple[int, int]]:
    """Offsets of the secret values."""
    if not text or not _GATE.search(text) and "PRIVATE KEY" not in text and not _WEIGHED.search(text):
        return []
    return _Scan(text, path or "").run()


def blank(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"[^\s\"'`+\\]", "x", text[a:b])]
        at = b
    return "".join(out) + text[at:]


RESULT = "struct<spans:array<struct<start_pos:int,end_pos:int,line_no:int>>,redacted:string>"


def _scan_series(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, paths in batches:
        spans, redacted = [], []
        for x, p in zip(texts, paths):
            s = find(x, p)
            spans.append([(a, b, x.count("\n", 0, a) + 1) for a, b in s])
            redacted.append(blank(x, s) if s else x)
        yield pd.DataFrame({"spans": spans, "redacted": redacted})


def scan(df: DataFrame, text: str, path: str | None = None, into: str = "secrets") -> DataFrame:
    """df with the spans of secrets in text and the text with them blanked out."""
    p = F.col(path) if path else F.lit("")
    return df.withColumn(into, F.pandas_udf(_scan_series, RESULT).asNondeterministic()(F.col(text), p.cast("string")))
