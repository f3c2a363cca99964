"""A pack of review rules over source, build and infrastructure files: what single patterns can tell beside the checkers.

Each rule has a name, the paths it looks at (a regular expression, none for all), words of which a file must hold one, lower
case, before any pattern runs, and patterns with their confidence.
"""

from __future__ import annotations

from .probes import Probe

_SOURCE = r"\.(?:py|js|mjs|ts|jsx|tsx|java|kt|go|cs|php|rb|rs|swift)$"
_MARKUP = r"\.(?:html?|vue|jsx|tsx|php|erb|jinja2?)$"
_SETTINGS = r"(?:\.(?:env|ini|cfg|conf|properties|ya?ml|toml|json|py|js|ts)|(?:^|/)\.env[\w.-]*)$"
_YAML = r"\.ya?ml$"
_TERRAFORM = r"\.(?:tf|tfvars|hcl)$"
_CI = r"(?:^|/)(?:\.github/workflows/.*\.ya?ml|\.gitlab-ci\.ya?ml|Jenkinsfile[^/]*|azure-pipelines\.ya?ml|\.circleci/.*|bitbucket-pipelines\.ya?ml)$"
_MOBILE = r"(?:\.(?:java|kt|swift|m|xml)|Info\.plist)$"
_COMPOSE = r"(?:^|/)(?:docker-)?compose[^/]*\.ya?ml$"
RULES: dict[str, tuple[str, str, str, list[tuple[str, float]]]] = {
    "SEC-01": ("Cloud credentials in source", "", "akia asia ghp_ glpat- aiza xoxb- xoxp-", [(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0.95), (r"\bghp_[0-9A-Za-z]{36,}\b", 0.95), (r"\bglpat-[\w-]{20,}", 0.9), (r"\bAIza[\w-]{35}\b", 0.9), (r"\bxox[bp]-[\w-]{20,}", 0.9)]),
    "SEC-02": ("Passwords and connection strings in source", "", "passw pwd ://", [(r"(?i)\b(?:password|passwd|pwd)\b['\"]?\s*[:=]\s*['\"][^'\"\s${<]{6,}['\"]", 0.6), (r"\b[a-z][a-z0-9+.-]+://[^\s:/@'\"]+:[^\s@'\"${<]+@[^\s'\"]+", 0.8)]),
    "SEC-03": ("Cryptographic keys in source", "", "private key secret_key secretkey aes", [(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0.95), (r"(?i)\b(?:secret|aes|encryption|hmac)_?key\b\s*[:=]\s*b?['\"][^'\"\s]{16,}['\"]", 0.7)]),
    "SEC-04": ("Test credentials left over", _SOURCE, "admin test123 changeme", [(r"(?i)\b(?:user(?:name)?|login)\b['\"]?\s*[:=]\s*['\"]admin['\"][\s\S]{0,80}?\b(?:password|pwd)\b['\"]?\s*[:=]\s*['\"](?:admin|test\d*|changeme|123456)['\"]", 0.7)]),
    "SEC-06": ("Query operators from input", _SOURCE, "$where find( findone(", [(r"\$where\s*['\"]?\s*:\s*(?:req|request|params|input|user)\w*", 0.75), (r"\.find(?:One)?\(\s*\{[^}]*:\s*(?:req|request)\.(?:body|query|params)", 0.65)]),
    "SEC-10": ("Directory filters from input", _SOURCE, "(uid= (cn= ldap", [(r"\((?:uid|cn|mail|sAMAccountName)=['\"]?\s*(?:\+|%s|\{|\$\{)", 0.7)]),
    "SEC-11": ("Templates from input", _SOURCE, "template", [(r"(?:render_template_string|Template|from_string|compile)\(\s*(?:req|request|input|user|params)\w*", 0.75)]),
    "SEC-12": ("Headers from input", _SOURCE, "header", [(r"(?i)(?:set_?header|add_?header|headers\[[^\]]+\]\s*=)\s*\(?[^;\n]*(?:req|request|params|input)\.", 0.55)]),
    "SEC-13": ("Prototypes reached by keys", r"\.(?:js|mjs|ts|jsx|tsx)$", "__proto__ merge( extend(", [(r"__proto__", 0.6), (r"(?:merge|extend|defaultsDeep)\([^)]*(?:req|request)\.(?:body|query)", 0.7)]),
    "SEC-16": ("Every origin allowed", _SETTINGS, "origin cors", [(r"(?i)access-control-allow-origin['\"]?\s*[:,=]\s*['\"]?\*", 0.75), (r"(?im)^\s*CORS_(?:ALLOW_ALL_ORIGINS|ORIGIN_ALLOW_ALL)\s*=\s*True", 0.8), (r"cors\(\s*\{[^}]*origin\s*:\s*(?:true|['\"]\*['\"])", 0.7)]),
    "SEC-26": ("Security headers switched off", _SOURCE, "x-frame content-security-policy helmet hsts", [(r"(?i)content-security-policy['\"]?\s*[:,=]\s*['\"][^'\"]*unsafe-(?:inline|eval)", 0.65), (r"(?i)x-frame-options['\"]?\s*[:,=]\s*['\"]ALLOWALL", 0.7), (r"helmet\(\s*\{[^}]*:\s*false", 0.55)]),
    "SEC-27": ("Sessions without protection", _SETTINGS, "session cookie", [(r"(?im)^\s*SESSION_COOKIE_(?:SECURE|HTTPONLY)\s*=\s*(?:False|false|0)", 0.75), (r"cookie\s*:\s*\{[^}]*(?:secure|httpOnly)\s*:\s*false", 0.7)]),
    "SEC-28": ("Sign-in flows without checks", _SOURCE, "response_type verify_signature state", [(r"response_type=token\b", 0.6), (r"verify_signature['\"]?\s*[:=]\s*False", 0.85)]),
    "SEC-29": ("Sockets without origin or encryption", _SOURCE, "ws:// checkorigin websocket", [(r"\bws://(?!localhost|127\.)", 0.6), (r"CheckOrigin\s*:\s*func\([^)]*\)\s*bool\s*\{\s*return true", 0.8)]),
    "SEC-30": ("Calls without transport security", _SOURCE, "insecure grpc", [(r"grpc\.insecure_channel\(|grpc\.WithInsecure\(|insecure\.NewCredentials\(|usePlaintext\(", 0.75)]),
    "SEC-31": ("Schema open to everyone", _SOURCE, "introspection graphiql playground", [(r"(?:introspection|playground|graphiql)\s*[:=]\s*(?:true|True)", 0.65)]),
    "SEC-35": ("Certificates with their key in the repository", r"\.(?:pem|key|p12|pfx|jks|crt)$", "private key", [(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0.9)]),
    "SEC-36": ("Scripts from the net in builds", _CI, "curl wget", [(r"(?:curl|wget)[^|\n]*\|\s*(?:sudo\s+)?(?:ba|z)?sh\b", 0.8)]),
    "SEC-37": ("Debugging left on", _SETTINGS, "debug node_env", [(r"(?im)^\s*(?:FLASK_)?DEBUG\s*[:=]\s*['\"]?(?:True|true|1)['\"]?\s*$", 0.7), (r"(?m)^\s*NODE_ENV\s*[:=]\s*['\"]?development['\"]?\s*$", 0.5), (r"\.run\([^)]*debug\s*=\s*True", 0.75)]),
    "SEC-38": ("Defaults that were never changed", _SETTINGS, "secret_key changeme allowed_hosts", [(r"(?im)^\s*SECRET_KEY\s*[:=]\s*['\"]?(?:changeme|secret|password|default|development)", 0.8), (r"ALLOWED_HOSTS\s*=\s*\[\s*['\"]\*['\"]", 0.65)]),
    "SEC-40": ("Versions with known faults", r"(?:^|/)(?:requirements[^/]*\.txt|package\.json|pom\.xml|go\.mod|build\.gradle)$", "log4j struts lodash pyyaml", [(r"log4j-core[^\n]{0,60}2\.(?:\d|1[0-6])(?:\.\d+)?\b", 0.85), (r"\"lodash\"\s*:\s*\"[\^~]?4\.(?:[0-9]|1[0-6])\.", 0.6), (r"(?im)^pyyaml==(?:[0-4]\.|5\.[0-3])", 0.7)]),
    "SEC-41": ("Foreign scripts without a digest", _MARKUP, "<script <link", [(r"<script[^>]+src=['\"]https?://(?![^>]*\bintegrity=)[^>]*>", 0.55)]),
    "SEC-42": ("Transport in plain text", _SOURCE, "http:// ftp:// telnet", [(r"['\"](?:http|ftp)://(?!localhost|127\.|0\.0\.0\.0|\[|(?:[\w-]+\.)*(?:example|test|local)\b|www\.w3\.org|schemas?\.)[\w.-]+", 0.4), (r"\btelnetlib\b", 0.7)]),
    "SEC-43": ("Secrets in logs and traces", _SOURCE, "log print span", [(r"(?i)\b(?:log(?:ger|ging)?|console)\.\w+\([^)\n]*\b(?:password|passwd|secret|token|api_?key|authorization)\b", 0.55), (r"(?i)set_?attribute\(\s*['\"][^'\"]*(?:password|token|secret)", 0.65)]),
    "SEC-44": ("Builds that outsiders can steer", _CI, "pull_request_target github.event uses: ${{", [(r"pull_request_target", 0.6), (r"run:[^\n]*\$\{\{\s*github\.event\.", 0.8), (r"uses:\s*[\w.-]+/[\w./-]+@(?:main|master)\b", 0.55)]),
    "SEC-60": ("Web views with too many rights", _MOBILE, "webview javascript", [(r"setJavaScriptEnabled\(\s*true|setAllow(?:File|UniversalAccessFromFileURLs)\w*\(\s*true|addJavascriptInterface\(", 0.65)]),
    "SEC-61": ("Secrets in local storage", r"\.(?:js|ts|jsx|tsx|java|kt|swift)$", "localstorage sharedpreferences userdefaults", [(r"(?i)(?:localStorage\.setItem|UserDefaults[^\n]*\.set|putString)\(\s*[^)\n]*(?:token|password|secret)", 0.65), (r"MODE_WORLD_(?:READABLE|WRITEABLE)", 0.85)]),
    "SEC-62": ("Links into the app without checks", _MOBILE, "android:scheme getintent openurl", [(r"<data\s+android:scheme=\"(?!https)[^\"]+\"", 0.5)]),
    "SEC-63": ("Data in backups", r"AndroidManifest\.xml$", "allowbackup", [(r"android:allowBackup\s*=\s*\"true\"", 0.7)]),
    "SEC-64": ("Every certificate accepted", _MOBILE, "trustmanager hostnameverifier arbitraryloads", [(r"checkServerTrusted\([^)]*\)\s*(?:throws \w+\s*)?\{\s*\}", 0.85), (r"ALLOW_ALL_HOSTNAME_VERIFIER|NSAllowsArbitraryLoads", 0.75)]),
    "SEC-65": ("Screens that can be recorded", _MOBILE, "flag_secure", [(r"clearFlags\([^)]*FLAG_SECURE", 0.7)]),
    "SEC-66": ("Secrets on the clipboard", _MOBILE, "clipboard pasteboard", [(r"(?i)(?:setPrimaryClip|UIPasteboard[^\n]*\.string\s*=)[^\n]*(?:password|token|secret)", 0.6)]),
    "IAC-01": ("Images built with too many rights", r"(?i)(?:^|/)dockerfile[^/]*$", "from user add", [(r"(?im)^\s*FROM\s+\S+:latest\b", 0.7), (r"(?im)^\s*USER\s+root\s*$", 0.8), (r"(?im)^\s*ADD\s+https?://", 0.7)]),
    "IAC-02": ("Services open to the host", _COMPOSE, "privileged network_mode docker.sock 0.0.0.0", [(r"(?m)^\s*privileged:\s*true", 0.8), (r"(?m)^\s*network_mode:\s*['\"]?host", 0.7), (r"/var/run/docker\.sock", 0.8), (r"['\"]?0\.0\.0\.0:\d+:", 0.55)]),
    "IAC-03": ("Containers that reach the host", _YAML, "hostpath docker.sock hostpid", [(r"(?m)^\s*(?:hostPID|hostIPC):\s*true", 0.8), (r"path:\s*/var/run/(?:docker|containerd)", 0.8)]),
    "IAC-04": ("Workloads with too many rights", _YAML, "privileged escalation hostnetwork runasnonroot", [(r"(?m)^\s*(?:privileged|allowPrivilegeEscalation|hostNetwork):\s*true", 0.8), (r"(?m)^\s*runAsNonRoot:\s*false", 0.75)]),
    "IAC-05": ("Network and storage open", _YAML, "loadbalancer nodeport hostpath", [(r"(?m)^\s*type:\s*NodePort", 0.5), (r"(?m)^\s*-?\s*hostPath:", 0.65)]),
    "IAC-06": ("Roles that may do all", _YAML, "verbs cluster-admin", [(r"verbs:\s*\[\s*['\"]?\*", 0.8), (r"name:\s*cluster-admin\b", 0.75)]),
    "IAC-07": ("Secrets in plain manifests", _YAML, "kind: secret stringdata", [(r"(?m)^stringData:", 0.6)]),
    "IAC-08": ("Storage open or not encrypted", _TERRAFORM, "public-read encrypted storage", [(r"acl\s*=\s*\"public-read(?:-write)?\"", 0.85), (r"(?:storage_)?encrypted\s*=\s*false", 0.75)]),
    "IAC-09": ("Networks open to all", _TERRAFORM, "0.0.0.0/0", [(r"cidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0\"", 0.75)]),
    "IAC-10": ("Policies that allow all", r"\.(?:tf|json)$", "action effect", [(r"\"?Action\"?\s*[:=]\s*\[?\s*\"\*\"", 0.75)]),
    "IAC-11": ("State and secrets in configuration", _TERRAFORM, "password secret access_key", [(r"(?m)^\s*(?:password|secret_key|access_key)\s*=\s*\"[^\"$]{6,}\"", 0.75)]),
    "IAC-12": ("Plays that show secrets", _YAML, "ansible become validate_certs", [(r"validate_certs:\s*(?:no|false)", 0.75), (r"ansible_(?:ssh_|become_)?pass(?:word)?:\s*(?!['\"]?\{\{)\S+", 0.75)]),
    "IAC-13": ("Charts with loose images", r"(?:^|/)values[^/]*\.ya?ml$", "tag: pullpolicy", [(r"(?m)^\s*tag:\s*['\"]?latest", 0.6)]),
    "IAC-14": ("Stacks open or not encrypted", r"\.(?:ya?ml|json|template)$", "aws::", [(r"CidrIp['\"]?:\s*['\"]?0\.0\.0\.0/0", 0.75), (r"(?:StorageEncrypted|Encrypted)['\"]?:\s*['\"]?false", 0.75)]),
    "IAC-15": ("Functions that may do all", r"(?:^|/)(?:serverless|template)\.ya?ml$", "iamrolestatements policies action", [(r"Action:\s*['\"]?\*", 0.75), (r"(?m)^\s*cors:\s*true", 0.5)]),
    "IAC-16": ("Programs that open the network", _SOURCE, "pulumi cidrblocks", [(r"cidrBlocks\s*:\s*\[\s*['\"]0\.0\.0\.0/0", 0.75)]),
    "IAC-17": ("Functions with secrets in their environment", _YAML, "environment variables", [(r"(?im)^\s*\w*(?:PASSWORD|SECRET|API_KEY)\w*:\s*(?!['\"]?(?:\$\{|!|\{\{))['\"]?[^\s'\"]{6,}", 0.6)]),
}
NAMES = {rule: name for rule, (name, *_) in RULES.items()}
PROBES = [Probe(rule, p, conf, f"{rule}/{i}", paths=paths, needs=tuple(words.split())) for rule, (_, paths, words, rows) in RULES.items() for i, (p, conf) in enumerate(rows)]
