"""Probes of generated text and code: dangerous calls, injections, unsafe parsers and settings."""

from __future__ import annotations

from .probes import Probe

# The patterns and confidences that results must agree on, by rule.
_TABLE = {
    "O-01": [
        (r"\b(?:eval|exec)\s*\(", 0.8), (r"\b(?:system|popen|__import__)\s*\(", 0.8), (r"subprocess\.(?:call|Popen|run)\s*\(", 0.85),
        (r"Runtime\.getRuntime\(\)\.exec\s*\(", 0.85), (r"new\s+ProcessBuilder\s*\(", 0.75), (r"Class\.forName\s*\(", 0.6), (r"Process\.Start\s*\(", 0.85),
        (r"exec\.Command\s*\(", 0.85), (r"os\.StartProcess\s*\(", 0.7), (r"syscall\.Exec\s*\(", 0.8), (r"(?:shell_exec|exec|system)\s*\(\s*\$", 0.7),
        (r"create_function\s*\(", 0.7), (r"popen\s*\(\s*\$", 0.7), (r"std::process::Command", 0.85), (r"Command::new\s*\(\s*['\"]sh['\"]", 0.8),
        (r"new\s+Function\s*\(\s*['\"]", 0.8), (r"child_process\.(?:exec|execSync|spawn|fork)\s*\(", 0.8), (r"`[^`]*\#\{?\w+[^`]*`", 0.7), (r"%x\([^)]*", 0.65),
    ],
    "O-03": [
        (r"subprocess\.(?:call|Popen|run)\s*\([^)]*shell\s*=\s*True", 0.75), (r"exec\.Command\s*\(\s*['\"]sh['\"]\s*,\s*['\"]-c['\"]\s*,", 0.8),
        (r"`[^`]*\#\{?\w+[^`]*`", 0.65), (r"shell_exec\s*\(\s*['\"][^'\"]*\$\{?\w+", 0.7), (r"\bexec\s*\(\s*['\"][^'\"]+\+[^'\"]+['\"]\s*\)", 0.7),
    ],
    "O-04": [
        (r"cursor\.execute\s*\(\s*(?:f['\"]|['\"][^'\"]*\+|['\"][^'\"]*\{[^}]+\})", 0.7), (r"(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b[^;]*\+\s*\w+", 0.7),
        (r"fmt\.Sprintf\s*\(\s*['\"](?:SELECT|INSERT|UPDATE|DELETE)", 0.75), (r"\b(?:query|sql)\s*(?::|=)\s*['\"][^'\"]*\{[^}]+\}", 0.6),
        (r"new\s+Statement\s*\(|createStatement\s*\(.*\+", 0.65), (r"SqlCommand\s*\(\s*['\"][^'\"]*\+", 0.65),
    ],
    "O-05": [
        (r"\$where\s*[:=]\s*['\"][^'\"]*\{?\w+", 0.7), (r"find\s*\(\s*\{[^}]*\$where", 0.7), (r"N1QLQuery\s*\(\s*['\"][^'\"]*\+", 0.7),
        (r"findByIdAnd(?:Update|Delete)\s*\(\s*\w+\s*,", 0.65),
    ],
    "O-06": [
        (r"except\s*(?:[A-Za-z_]\w*)?\s*:\s*\n\s*pass\b", 0.8), (r"catch\s*\(\s*(?:_|[A-Za-z_]\w*(?:\s+\w+)?)\s*\)\s*\{\s*\}", 0.8),
        (r"if\s+err\s+!=\s+nil\s*\{\s*\n\s*return\b", 0.6), (r"\/\/\s*(?:swallow|ignore|silently|nothing)\s*(?:error|exception)?", 0.7), (r"catch\s+\{\s*\}", 0.8),
    ],
    "O-08": [
        (r"DocumentBuilderFactory\.newInstance\(\)(?![\s\S]*?setFeature.*disallow-doctype-dec)", 0.65), (r"new\s+XmlDocument\s*\([^)]*\)\s*\{[^}]*\bXmlResolver\s*=", 0.7),
        (r"simplexml_load_string\s*\(", 0.6), (r"xml\.Decoder\s*\{[^}]*\bStrict\s*=\s*false", 0.7), (r"lxml\.(?:fromstring|parse|XML)\s*\([^)]*\bresolve_entities\s*(?!=\s*False)", 0.65),
    ],
    "O-09": [
        (r"render_template_string\s*\(\s*(?:f['\"]|['\"][^'\"]*\+|['\"][^'\"]*\{[^}]+\})", 0.75), (r"Template\s*\(\s*['\"][^'\"]*\+[^'\"]+['\"]\s*\)\s*\.render", 0.7),
        (r"Handlebars\.compile\s*\(\s*\w+\s*\+", 0.65), (r"\$smarty->fetch\s*\(\s*['\"][^'\"]*\$", 0.7),
    ],
    "O-10": [(r"['\"][^'\"]*\b(?:uid|cn|sn|mail)\s*=\s*['\"]\s*\+\s*\w+", 0.7), (r"DirContext\.(?:search|lookup|list)\s*\(\s*['\"][^'\"]*\+\s*\w+", 0.75)],
    "O-11": [
        (r"(?:pickle\.(?:loads|load)|shelve\.open)\s*\(", 0.85), (r"yaml\.(?:load|load_all)\s*\([^)]*(?:(?!SafeLoader|CSafeLoader).)", 0.8),
        (r"ObjectInputStream\.(?:readObject|readUnshared)\s*\(", 0.9), (r"\bunserialize\s*\(\s*\$", 0.85), (r"Marshal\.(?:load|restore)\s*\(", 0.85),
        (r"new\s+BinaryFormatter\s*\([^)]*\).*\.Deserialize\s*\(", 0.85), (r"XMLDecoder\s*\(", 0.85),
    ],
    "O-12": [
        (r"requests\.(?:get|post|put|delete|patch|request)\s*\(\s*\w+(?:url|input|user|param|query|body|data|host|endpoint)?\b", 0.6),
        (r"axios\.(?:get|post|put|delete|patch|request)\s*\(\s*\w+(?:url|input|user|param|query|body|data)?\b", 0.6),
        (r"fetch\s*\(\s*\w+(?:url|input|user|param|query|body|data)?\b", 0.55), (r"HttpClient\.(?:execute|SendAsync)\s*\(\s*\w+", 0.6),
        (r"http\.(?:Get|Post|NewRequest)\s*\(\s*\w+", 0.55),
    ],
    "O-13": [
        (r"verify\s*=\s*(?:False|false|0)", 0.8), (r"check_hostname\s*=\s*(?:False|false)", 0.8), (r"rejectUnauthorized\s*[:=]\s*(?:false|0)", 0.85),
        (r"InsecureSkipVerify\s*[:=]\s*(?:true|True)", 0.85), (r"ServerCertificateValidationCallback\s*[:=]\s*\{[^}]*true\s*\}", 0.85),
        (r"(?i)VERIFY_NONE", 0.85), (r"(?i)trustAllCertificates|trust_all_certs", 0.85),
    ],
    "O-14": [
        (r"_\.(?:merge|defaults|assign)\s*\([^)]*\b(?:body|input|query|param|user|data)", 0.65), (r"Object\.(?:assign|create)\s*\([^)]*\b(?:body|input|query|param|user|data)", 0.6),
        (r"\[\s*['\"]__proto__['\"]\s*\]", 0.75), (r"\b__proto__\b", 0.65), (r"\[\s*['\"]constructor['\"]\s*\]\s*\[\s*['\"]prototype['\"]\s*\]", 0.75),
    ],
    "O-15": [
        (r"(?:open|os\.path\.join)\s*\([^)]*\w+(?:input|user|file|name|path|filename)?\b", 0.55), (r"Path\.Combine\s*\([^)]*\w+(?:input|user|file|name|path|fileName)?\b", 0.6),
        (r"(?:file_get_contents|unlink|fopen)\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", 0.8), (r"new\s+File\s*\(\s*\w+(?:input|user|file|name|path|fileName)?\b", 0.5),
    ],
    "O-16": [(r"\([^()]+\+\)\+", 0.65), (r"\([^()]+\+\)\*", 0.65), (r"\([^()]+\*\)\+", 0.65), (r"\([^()]+\*\)\*", 0.65)],
    "O-17": [
        (r"innerHTML\s*=\s*\w+", 0.65), (r"outerHTML\s*=\s*\w+", 0.65), (r"document\.write\s*\(\s*\w+", 0.65), (r"dangerouslySetInnerHTML\s*=\s*\{?\s*__html", 0.75),
        (r"v-html\s*=\s*['\"]?\s*\w+", 0.65), (r"href\s*=\s*['\"][\s]*javascript:", 0.85), (r"window\.location\s*=\s*\w+(?:input|user|param|query|data)", 0.65),
    ],
}
_RANDOM = [(r"^import random$|^from random import", 0.75), (r"\brand\s*\(\s*\)|\bmt_rand\s*\(\s*\)", 0.7), (r"Math\.random\s*\(\s*\)", 0.7), (r"java\.util\.Random\b", 0.8), (r"new\s+Random\s*\(\s*\)", 0.65), (r"math/rand\"", 0.7)]
_SHELL = [
    (r"rm\s+(?:-rf|\/|\-rf\s+\/|\-rf\s+\/\*)", 0.9), (r":\s*\(\s*\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:", 0.95), (r"dd\s+if=\s*\/dev\/zero\s+of=\s*\/dev\/sd", 0.9),
    (r"\bmkfs\.\w+\s+\/dev\/", 0.85), (r"chmod\s+-R\s+777\s+\/", 0.9), (r"mv\s+\/\s+\/dev\/null", 0.9), (r"shutdown\s+(?:\-h\s+now|\-r\s+now|/s)", 0.7),
]
PROBES = [Probe(rule, p, conf, f"{rule}/{i}") for rule, rows in _TABLE.items() for i, (p, conf) in enumerate(rows)]
PROBES += [Probe("O-02", p, conf, f"O-02/{i}") for i, (p, conf) in enumerate(_SHELL)]
PROBES += [Probe("O-07", p, conf, f"O-07/{i}", wanted="token|password|secret|session|csrf|jwt|key|hash") for i, (p, conf) in enumerate(_RANDOM)]
#: Requests, in Chinese, to forget what was said before.
RESET = [
    Probe("I-48", r"(?:忘记|清除|清空|重置|忽略|忽略掉|删除|移除|丢弃)\s*(?:所有|全部|之前|过去的|以前的)\s*(?:对话|聊天|历史|记录|记忆|内容|上下文|context)", 0.6, ignore_case=True, plain=True),
    Probe("I-48", r"(?:重新开始|新对话|新会话|新聊天|重新会话)\s*(?:对话|聊天|session|conversation)?", 0.5, ignore_case=True, plain=True),
    Probe("I-48", r"(?:不要|不需要|不用|别)\s*(?:记忆|记住|记得|上下文|历史|之前)", 0.5, ignore_case=True, plain=True),
]
#: Input longer than this is oversized (a fixed value), I-43.
OVERSIZED = 100_000
#: Checkers by rule: a rule of this id fires on these too, whatever patterns it has.
CHECKERS: dict[str, list[Probe]] = {}
for _p in (*PROBES, *RESET):
    CHECKERS.setdefault(_p.rule_id, []).append(_p)
