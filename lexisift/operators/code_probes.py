"""Probes of source and configuration files, with the kinds of files that each looks at."""

from __future__ import annotations

from .probes import Probe

_WEB = ("py", "js", "ts", "java", "go", "cs", "php", "rb")
_WEB_RS = (*_WEB, "rs")
_WEB_SQL = (*_WEB, "sql")
# Extensions, then patterns and confidences that results must agree on, by rule.
_TABLE: dict[str, tuple[tuple[str, ...], list[tuple[str, float]]]] = {
    "SEC-07": (_WEB_RS, [
        (r"subprocess\.(?:call|Popen|run)\s*\([^)]*shell\s*=\s*True", 0.7), (r"os\.system\s*\(\s*(?:f['\"]|['\"][^'\"]*\+)", 0.75), (r"Runtime\.getRuntime\(\)\.exec\s*\([^)]*\+", 0.75),
        (r"Runtime\.getRuntime\(\)\.exec\s*\(\s*new\s+String\[\]", 0.7), (r"exec\.Command\s*\(\s*['\"]sh['\"]\s*,\s*['\"]-c['\"]", 0.8), (r"(?:exec|execSync)\s*\(\s*`[^`]*\$\{?\w+", 0.7),
        (r"require\s*\(\s*['\"]child_process['\"]\s*\)", 0.55), (r"(?:shell_exec|exec)\s*\(\s*\$", 0.7), (r"system\s*\(\s*['\"][^'\"]*\$", 0.65), (r"`[^`]*\#\{?\w+[^`]*`", 0.65),
        (r"(?:exec|system)\s*\(\s*(?:f['\"]|['\"][^'\"]*\+)", 0.65), (r"\$\w+\s+#.*(?:injection|input|sanitiz)", 0.5)]),
    "SEC-08": (("py", "java", "php", "rb", "cs", "js", "ts", "go"), [
        (r"(?:pickle\.(?:loads|load)|shelve\.open)\s*\(", 0.85), (r"yaml\.(?:load|load_all)\s*\([^)]*(?:(?!SafeLoader|CSafeLoader).)", 0.8), (r"ObjectInputStream\.(?:readObject|readUnshared)\s*\(", 0.9),
        (r"\bunserialize\s*\(\s*\$", 0.85), (r"Marshal\.(?:load|restore)\s*\(", 0.85), (r"new\s+BinaryFormatter\s*\([^)]*\).*\.Deserialize\s*\(", 0.85), (r"XMLDecoder\s*\(", 0.85), (r"node-serialize|node_serialize", 0.7)]),
    "SEC-09": (_WEB, [
        (r"DocumentBuilderFactory\.newInstance\(\)(?![\s\S]*?setFeature.*disallow-doctype-dec)", 0.65), (r"new\s+XmlDocument\s*\([^)]*\)\s*\{[^}]*\bXmlResolver\s*=", 0.7), (r"simplexml_load_string\s*\(", 0.6),
        (r"xml\.Decoder\s*\{[^}]*\bStrict\s*=\s*false", 0.7), (r"lxml\.(?:fromstring|parse|XML)\s*\([^)]*\bresolve_entities\s*(?!=\s*False)", 0.65)]),
    "SEC-14": (("py", "js", "ts", "java", "php", "rb"), [
        (r"\b(?:eval|exec)\s*\(\s*(?:req|request|input|user|data|body|query|params)\b", 0.85), (r"\bFunction\s*\(\s*(?:req|request|input|user|data)\b", 0.8), (r"ScriptEngine\.eval\s*\(\s*(?:req|request|input|user)\b", 0.85),
        (r"create_function\s*\(\s*\$", 0.75), (r"\bassert\s*\(\s*\$_(?:GET|POST|REQUEST)", 0.85), (r"(?:eval|instance_eval)\s*\(\s*(?:params|input|user|data)", 0.75), (r"eval\s*\(\s*__import__\s*\(", 0.85)]),
    "SEC-15": (("js", "ts", "jsx", "tsx", "vue", "html", "php", "svelte"), [
        (r"innerHTML\s*=\s*(?!['\"])\w+", 0.65), (r"dangerouslySetInnerHTML\s*=\s*\{*\s*__html", 0.75), (r"v-html\s*=\s*['\"]?\s*\w+", 0.65), (r"document\.write\s*\(\s*\w+", 0.65),
        (r"\.html\(\s*(?!['\"])\w+", 0.6), (r"\{@html\s+\w+", 0.65), (r"\|\s*safe\s*\}", 0.5), (r"\[innerHtml\]\s*=\s*\w+", 0.6), (r"res\.(?:send|render)\s*\(\s*`[^`]*\$\{", 0.65)]),
    "SEC-19": (_WEB, [
        (r"requests\.(?:get|post|put|delete|patch|request)\s*\(\s*\w+(?:url|input|user|param|query|body|data|host|endpoint)?\b", 0.6),
        (r"axios\.(?:get|post|put|delete|patch|request)\s*\(\s*\w+(?:url|input|user|param|query|body|data)?\b", 0.6), (r"fetch\s*\(\s*\w+(?:url|input|user|param|query|body|data)?\b", 0.55),
        (r"HttpClient\.(?:execute|SendAsync)\s*\(\s*\w+", 0.6), (r"new\s+URL\s*\(\s*\w+", 0.65), (r"openConnection\s*\(\s*\)", 0.55), (r"http\.(?:Get|Post|NewRequest)\s*\(\s*\w+", 0.55),
        (r"open-uri\s*\(\s*\w+", 0.55), (r"curl_exec\s*\(\s*\$", 0.6)]),
    "SEC-23": (("php", "js", "ts", "py", "java", "go"), [
        (r"(?:include|require|include_once|require_once)\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", 0.85), (r"(?:include|require)\s*\(\s*['\"][^'\"]*\$\{?\w+", 0.7),
        (r"fs\.readFile\s*\(\s*\w+(?:input|user|param|query|path|file)?\b", 0.6), (r"\bopen\s*\(\s*(?:f['\"]|\w+(?:input|user|filename|filepath|path|page|file)\b)\s*[),]", 0.55),
        (r"Paths\.get\s*\([^)]*\w+(?:file|path|name|input|user)?\b", 0.55)]),
    "SEC-17": (_WEB, [
        (r"(?i)@csrf\.exempt\b", 0.85), (r"(?i)\bcsrf_exempt\b", 0.85), (r"(?i)protect_from_forgery\s+(?:except|skip)", 0.7), (r"(?i)@CrossOrigin\([^)]*allowCredentials", 0.6),
        (r"(?i)csrf\(\)\.disable\(\)", 0.85), (r"(?i)\.csrf\(\)\.disable\(\)", 0.85), (r"<form[^>]*action=[^>]*method=[\"']POST[\"'][^>]*>", 0.5)]),
    "SEC-20": (_WEB, [
        (r"redirect\s*\(\s*(?:request|req)\.(?:GET|args|query|params)\.get\s*\(\s*['\"](?:next|url|redirect|return)['\"]", 0.7),
        (r"redirect\s*\(\s*(?:request|req)\.(?:args|values)\s*\[?\s*['\"](?:next|url|redirect)['\"]", 0.65), (r"res\.redirect\s*\(\s*(?:req|request)\.", 0.6), (r"redirect_to\s+(?:params|req|request)", 0.6)]),
    "SEC-21": (_WEB, [
        (r"(?:request\.files|request\.FILES|request->file|req\.file|upload|form\.file)\s*\(?[^)]*\)?\.\s*(?:save|store|put|write)", 0.65), (r"multer\s*\(\s*\{[^}]*\bdest\b[^}]*\}\s*\)", 0.6),
        (r"MultipartFile\.transferTo\s*\(", 0.65), (r"->store\s*\(\s*\$request", 0.65)]),
    "SEC-24": (_WEB, [
        (r"(?:User|Model|Entity)\.(?:create|update|save)\s*\(\s*(?:req|request)\.(?:body|params|data|json)", 0.65), (r"(?:create|build|assign_attributes)\s*\(\s*(?:params|request_params)\b", 0.6),
        (r"TryUpdateModel\s*\([^)]*\b(?:Request|Input)\b", 0.6)]),
    "SEC-25": (_WEB, [
        (r"['\"]alg['\"]\s*:\s*['\"]none['\"]", 0.9), (r"(?i)jwt\.(?:sign|encode)\s*\([^)]*['\"](?:secret|jwt_secret|my_secret)['\"]", 0.75),
        (r"(?i)\bJWT_SECRET\s*[:=]\s*['\"](?:secret|changeme|password)['\"]", 0.8), (r"(?i)\balgorithm\s*=\s*['\"]none['\"]", 0.9)]),
    "SEC-45": (_WEB_RS, [
        (r"os\.path\.join\s*\([^)]*\w+(?:input|user|file|name|path|filename)?\b\s*,", 0.55), (r"Path\.Combine\s*\([^)]*\w+(?:input|user|file|name|path|fileName|filename)?\b", 0.6),
        (r"(?:file_get_contents|unlink|file_put_contents|fopen)\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", 0.8), (r"new\s+File\s*\(\s*\w+(?:input|user|file|name|path|fileName)?\b", 0.5)]),
    "SEC-51": (_WEB_RS, [
        (r"os\.system\s*\(", 0.85), (r"subprocess\.(?:call|Popen|run|check_output|check_call)\s*\(", 0.75), (r"Runtime\.getRuntime\(\)\.exec\s*\(", 0.85), (r"exec\.Command\s*\(", 0.8),
        (r"child_process\.(?:exec|execSync|execFile|spawn)\s*\(", 0.8), (r"(?:^|\W)execSync\s*\(", 0.75), (r"Process\.Start\s*\([^)]*['\"](?:cmd|bash|sh|powershell)", 0.8), (r"ProcessBuilder\s*\(", 0.75),
        (r"std::process::Command\s*::\s*new", 0.8), (r"ShellExecute\s*\(", 0.75)]),
    "SEC-32": (_WEB_RS, [
        (r"(?i)\bhashlib\.md5\b|\bMessageDigest\.getInstance\s*\(\s*['\"]MD5", 0.85), (r"(?i)\bhashlib\.sha1\b|\bMessageDigest\.getInstance\s*\(\s*['\"]SHA-?1", 0.85), (r"(?i)AES/ECB/", 0.85),
        (r"(?i)DES(?:CryptoServiceProvider|\.new)\b", 0.8), (r"(?i)KeyGenerator\.getInstance\s*\(\s*['\"]DES", 0.8), (r"(?i)Cipher\.getInstance\s*\(\s*['\"]DES", 0.8)]),
    "SEC-33": (_WEB, [
        (r"^import random$|^from random import", 0.75), (r"Math\.random\s*\(\s*\)", 0.7), (r"java\.util\.Random\b", 0.8), (r"new\s+Random\s*\(\s*\)", 0.65),
        (r"\brand\s*\(\s*\)|\bmt_rand\s*\(\s*\)", 0.7), (r"math/rand\"", 0.7)]),
    "SEC-34": (_WEB, [
        (r"verify\s*=\s*(?:False|false|0)", 0.8), (r"rejectUnauthorized\s*[:=]\s*(?:false|0)", 0.85), (r"InsecureSkipVerify\s*[:=]\s*(?:true|True)", 0.85),
        (r"ServerCertificateValidationCallback\s*[:=]\s*\{[^}]*true\s*\}", 0.85), (r"(?i)VERIFY_NONE", 0.85), (r"(?i)CURLOPT_SSL_VERIFYPEER\s*[:=]\s*0", 0.8)]),
    "SEC-48": (("py", "java", "go", "cs", "php", "rb"), [(r"(?:zipfile|tarfile)\.(?:extractall|extract)\s*\(", 0.7), (r"ZipInputStream\.getNextEntry", 0.65), (r"extractall\s*\([^)]*", 0.6)]),
    "SEC-49": (("c", "cpp", "cxx", "rs"), [(r"\bgets\s*\(", 0.85), (r"\bstrcpy\s*\(", 0.75), (r"\bsprintf\s*\(", 0.6), (r"\bscanf\s*\(", 0.55), (r"\bstrcat\s*\(", 0.7)]),
    "SEC-50": (_WEB, [(r"traceback\.format_exc\s*\(", 0.75), (r"err\.stack", 0.65), (r"e\.ToString\(\)", 0.65), (r"print_exc\s*\(", 0.7)]),
    "SEC-46": (("py", "js", "ts", "java", "go", "cs", "rb"), [(r"(?i)if\s+os\.path\.exists\b", 0.4), (r"if\s+not\s+os\.path\.exists.*[\\\n].*\b(?:open|remove|rename)\b", 0.5)]),
    "SEC-47": (("py", "js", "ts", "java", "go", "cs"), [(r"while\s+True\s*:", 0.5), (r"(?i)requests\.get\s*\([^)]*\)\s*(?:(?!timeout).)*$", 0.4)]),
    "SEC-52": (_WEB, [
        (r"logging\.(?:info|debug|error|warning)\s*\(\s*(?:f['\"]|['\"][^'\"]*\+\s*\w+|['\"][^'\"]*\{[^}]+\})", 0.55), (r"log\.(?:info|debug|error|warn)\s*\(\s*(?:f['\"]|['\"][^'\"]*\+\s*\w+)", 0.55),
        (r"logger\.(?:info|debug|error|warn)\s*\(\s*(?:f['\"]|['\"][^'\"]*\+\s*\w+)", 0.55), (r"print\s*\(\s*['\"][^'\"]*\+\s*\w+(?:input|user|param|data|body|req)", 0.55)]),
    "SEC-56": (_WEB, [(r"(?i)(?:min[_\.]?(?:length|len|size)|minLength)\s*[:=<>!]+\s*([456])\b", 0.65), (r"(?i)(?:len|length)\s*\(\s*(?:password|passwd|pwd)\s*\)\s*[<]\s*([6789])", 0.6)]),
}
# String building in SQL, case ignored; a statement that ends in a parameter is no hit.
_SQL = [
    r"(?:cursor|execute|query|exec)\s*\(\s*(?:f['\"]|['\"][^'\"]*\+|\+ [^'\"]*['\"])", r"(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b[^;]*\+\s*\w+", r"(?:SELECT|INSERT|UPDATE|DELETE)[^`]*\$\{\w+\}",
    r"fmt\.Sprintf\s*\(\s*['\"](?:SELECT|INSERT|UPDATE|DELETE)", r"\.raw\s*\(\s*(?:f['\"]|['\"][^'\"]*\+|['\"][^'\"]*\w+\s*)", r"\$sql\s*[.=].*\$_(?:GET|POST|REQUEST)",
    r"(?:createStatement|prepareStatement)\s*\([^)]*\+", r"SqlCommand\s*\(\s*['\"][^'\"]*\+", r"db\.(?:Exec|Query|QueryRow)\s*\([^)]*\+",
]
_HASHED = r"bcrypt|argon2|scrypt|hash|pbkdf2|make_password"
# Hits that a word nearby excuses.
_OVER = ("py", "js", "ts", "java", "go", "cs", "rb", "c", "cpp")
_ABSENT = [
    Probe("SEC-18", r"@(?:app\.(?:route|get|post|put|delete|patch)|csrf_exempt)\s*\(", 0.45, "route", extensions=_WEB, unless=r"@(?:login_required|jwt_required|permission_required|user_passes_test)", after=500, nowhere=r"@app\.before_request", longer=30),
    Probe("SEC-18", r"@app\.(?:route|get|post|put|delete)\(", 0.4, "handler", extensions=_WEB, unless=r"@login_required", after=500, nowhere=r"@app\.before_request", longer=30),
    Probe("SEC-18", r"router\.(?:get|post|put|delete|patch)\s*\(\s*['\"][^'\"]*['\"]\s*,", 0.35, "router", extensions=_WEB, unless=r"verifyToken|isAuthenticated|authenticate|authMiddleware|requireAuth", after=300, longer=30),
    Probe("SEC-22", r"(?:router|app)\.(?:get|post|put|delete|patch)\s*\(\s*['\"][^'\"]*[:<](\w+)[>'\"]", 0.4, "parameter", extensions=_WEB, follows=r"(?i)(?:find|findById|query|get|where|filter)\s*\([^)]*{0}", unless=r"(?i)owner|user_id|current_user|req\.user|userId|authorize|check|can_|permission", after=500, longer=30),
    Probe("SEC-53", r"(?:balance|amount|total|count|quantity|credits?)\s*-=\s*\w+", 0.45, "unguarded", extensions=_OVER, unless=r"(?:>=|if\s+\w+\s*[><])\s*\w+(?:balance|amount|total|credits)", line_before=300),
    Probe("SEC-53", r"(?:user_input|userInput|input|req|body)\b[^;]*[*]\s*(?:price|amount|count|rate|qty)", 0.5, "multiplied", True, _OVER),
    Probe("SEC-55", r"(?i)(?:INSERT\s+INTO\s+\w+\s*\([^)]*password[^)]*\))", 0.55, "insert", extensions=_WEB_SQL, unless=r"(?i)bcrypt|argon2|scrypt|hash(?!\s*map)|pbkdf2|sha", after=200),
    Probe("SEC-55", r"(?i)(?:password|passwd|pwd)\s*=\s*['\"][^'\"]{3,}['\"]", 0.5, "assigned", extensions=_WEB_SQL, unless=_HASHED, before=300, after=100),
    Probe("SEC-55", r"\.insert(?:One|Many)?\s*\([^)]*password[^)]*\)", 0.55, "document", True, _WEB_SQL, unless=r"bcrypt|argon2|scrypt|hash|pbkdf2", before=300, after=100),
    Probe("SEC-55", r"(?:execute|exec|query)\s*\([^)]*password[^)]*\+[^)]*\)", 0.55, "statement", True, _WEB_SQL, unless=_HASHED, before=300, after=100),
    Probe("SEC-57", r"(?i)(?:DELETE|UPDATE)\s+(?:FROM\s+)?(?:users?|accounts?|transactions?|employees?)\s+WHERE", 0.5, "rows", extensions=_WEB_SQL, unless=r"(?i)audit|log|record", after=300),
    Probe("SEC-57", r"(?i)(?:GRANT|REVOKE)\s+.*\s+(?:TO|FROM)\s+\w+", 0.55, "rights", extensions=_WEB_SQL, unless=r"(?i)audit|log", after=300),
    Probe("SEC-58", r"(?i)(?:def\s+login|def\s+signin|function\s+login)\s*\(", 0.45, "login", extensions=_WEB, unless=r"(?i)rate.?limit|throttle|lockout|fail.?count|max.?attempt|captcha", after=500),
    Probe("SEC-59", r"(?i)(?:is_deleted\s*=\s*True|deleted_at\s*=|deleted_flag\s*=\s*1)", 0.5, "soft", extensions=_WEB_SQL, unless=r"(?i)cleanup|purge|vacuum|physical.?delete|hard.?delete|archive", before=200, after=300),
]
PROBES = [Probe(rule, p, conf, f"{rule}/{i}", extensions=ext) for rule, (ext, rows) in _TABLE.items() for i, (p, conf) in enumerate(rows)]
PROBES += [Probe("SEC-05", p, 0.7, f"SEC-05/{i}", True, _WEB, not_ending=("?", "%s", "%d")) for i, p in enumerate(_SQL)]
PROBES += _ABSENT
NAMES = {
    "SEC-05": "SQL injection", "SEC-07": "OS command injection", "SEC-08": "Unsafe deserialization", "SEC-09": "XML external entities", "SEC-14": "Code injection", "SEC-15": "Cross-site scripting",
    "SEC-17": "CSRF protection missing", "SEC-18": "Authentication missing", "SEC-19": "Server-side request forgery", "SEC-20": "Open redirect", "SEC-21": "Unrestricted upload", "SEC-22": "Insecure direct object reference", "SEC-23": "File inclusion",
    "SEC-24": "Mass assignment", "SEC-25": "JWT defect", "SEC-32": "Weak cryptography", "SEC-33": "Insecure randomness", "SEC-34": "TLS validation disabled", "SEC-45": "Path traversal", "SEC-46": "Race condition",
    "SEC-47": "Resource exhaustion", "SEC-48": "Archive traversal", "SEC-49": "Memory safety", "SEC-50": "Error leak", "SEC-51": "Direct command execution", "SEC-52": "Log injection", "SEC-53": "Integer overflow", "SEC-54": "Null dereference", "SEC-39": "Dependency confusion",
    "SEC-55": "Password stored in plain text", "SEC-56": "Weak password policy", "SEC-57": "Audit log missing", "SEC-58": "No brute-force protection", "SEC-59": "Incomplete deletion",
}
