"""Signature data: user agent tokens, exploit marks, and the ordered probe rules.

Rules are data; they are compiled to one CASE in `classify`. Fixed values: tokens, marks, path
tests, statuses, thresholds and windows define the results and are listed in rule order.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values. Agent tokens by category, in match order.
AGENTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("security_testing", (
        "zgrab", "censys", "internetmeasurement", "leakix", "l9scan", "palo alto", "sqlmap", "nikto", "dirbuster", "gobuster", "masscan", "nmap",
        "nuclei", "acunetix", "nessus", "openvas", "shodan", "whatweb", "wprecon", "netcraft", "wp2shell", "r00ts3c", "vitesweep", "metabase-cve",
        "l9explore", "l9tcpid", "zmap", "rawgrab", "cgrab", "masscan-ng", "wanscanner", "siteradar", "rootevidence", "qmx-internet", "net-research",
        "ai-exposure", "host-probe", "fhms-its", "ffuf", "feroxbuster", "wfuzz", "wpscan", "commix", "dsss", "mozlila", "mozila/",
    )),
    ("ai_crawler", (
        "bytespider", "agentgpt", "auto-gpt", "babyagi", "oai-searchbot", "gptbot", "ccbot", "claude-web", "claudebot", "diffbot", "facebookbot",
        "applebot-extended", "anthropic-ai", "cohere-ai", "perplexitybot", "amazonbot", "scoutjet", "omgili", "youbot", "duckassistbot", "agenttrustbot",
    )),
    ("bad_scraper", (
        "seokicks", "dotbot", "blexbot", "megaindex", "mj12bot", "petalbot", "barkrowler", "80legs", "360spider", "404checker", "404enemy", "admantx",
        "aibot", "backlinkcrawler", "cognitiveseo", "coccocbot", "proximic", "rogerbot", "screaming frog", "searchmetricsbot", "semrushbot", "semrush",
        "ahrefsbot", "serpstatbot", "sistrix", "spbot", "zoominfobot", "pandalytics", "recordedfuture", "techspybot", "superbot", "offline explorer",
    )),
    ("search", ("googlebot", "bingbot", "yandexbot", "duckduckbot", "baiduspider", "sogou", "qwantify")),
    ("social_preview", ("twitterbot", "facebookexternalhit", "slackbot", "telegrambot", "whatsapp", "linkedinbot", "pinterest", "discordbot", "applebot")),
    ("monitoring", ("pingdom", "uptimerobot", "betteruptime", "datadog", "newrelic", "statuscake", "nodeping", "site24x7")),
    ("ads_verification", ("google-adwords", "adbeat", "adidxbot")),
    ("feed_fetching", ("feedfetcher-google", "rssmicro", "feedspot")),
    ("generic_tools", (
        "java/", "java", "perl", "python-requests", "python-urllib", "python/", "python", "go-http-client", "apache-httpclient", "scrapy", "curl/", "curl",
        "wget/", "wget", "libwww-perl", "aiohttp", "httpx", "httpie", "postmanruntime", "insomnia", "axios", "okhttp", "fasthttp", "dart/",
        "alittle client", "quic-go", "libredtail",
    )),
)
#: Fixed values. Other names of agent categories, and those blocked by default.
ALIASES = {
    "ads": "ads_verification", "search_crawler": "search", "ai": "ai_crawler", "feeds": "feed_fetching", "scanners": "security_testing",
    "social": "social_preview", "aggressive_seo": "bad_scraper", "tools": "generic_tools", "missing": "empty", "unknown": "browser_or_unknown",
}
BLOCKED_BY_DEFAULT = ("security_testing", "bad_scraper", "generic_tools", "empty")
REPLAY_BLOCKED = ("security_testing", "ai_crawler", "bad_scraper", "generic_tools", "empty")
#: Fixed values. Threat categories and their codes.
CATEGORY_CODES = {"common": 1, "cloud": 2, "ssh": 3, "vcs": 4, "ide": 5, "wordpress": 6, "php": 7, "laravel": 8, "actuator": 9, "webmail": 10, "backups": 11}
#: Fixed values. Exploit kinds of a header: (kind, marks in any case or exact, fold case).
HEADER_EXPLOITS = (
    ("jndi", ("${jndi:",), True),
    ("shellshock", ("() {",), False),
    ("php_tag", ("<?=", "<?php"), True),
    ("code_injection", ("eval(", "base64_decode("), True),
    ("null_byte", ("\x00", "%00"), False),
    ("crlf", ("\r", "\n", "%0d%0a"), True),
    ("path_traversal", ("/etc/passwd", "windows\\system32", "windows/system32", "windows\\\\system32"), True),
)
REFERER_EXPLOITS = (("${jndi:", ("${jndi:",)), ("<script", ("<script",)), ("path_traversal", ("..\\", "../", "%2e%2e")))
SCANNER_METHODS = ("PROPFIND", "DEBUG", "SEARCH", "TRACK", "TRACE")

SQM, GH = ("GET", "HEAD", "QUERY"), ("GET", "HEAD")
OK = (*range(200, 208), 301, 302)
MOVED = (200, 301, 302)
WP_ERRORS = (400, 403, 404, 405, 444)


@dataclass(frozen=True)
class Rule:
    """A path test (any of has, ends, starts; none: always) with a status test (unless: not one
    of; only: one of), and a decision: pass, instant, or a strike for the methods in `safe` (all if
    empty) with `other` for the rest: instant, or a strike with another threshold. `dotted` rules
    need `/.` in the path; statuses in `calm` pass for the safe methods."""

    id: str
    category: str | None = None
    has: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    unless: tuple[int, ...] = ()
    only: tuple[int, ...] = ()
    kind: str = "instant"
    threshold: int | None = None
    window: int | None = None
    safe: tuple[str, ...] = ()
    other: int | None = None
    dotted: bool = False
    calm: tuple[int, ...] = ()


def _shared(n: int, w: int = 10, safe: tuple[str, ...] = ()) -> dict:
    return {"kind": "shared", "threshold": n, "window": w, "safe": safe}


def _isolated(n: int, w: int = 10, safe: tuple[str, ...] = (), other: int | None = None) -> dict:
    return {"kind": "isolated", "threshold": n, "window": w, "safe": safe, "other": other}


_KEYS = ("/id_rsa", "/id_ed25519", "/id_ecdsa")
_CLOUD = ("/azure-credentials.json", "/terraform.tfstate", "/terraform.tfvars", "/firebase-adminsdk.json", "/service-account.json", "/application_default_credentials.json")
_GCP = ("/gcp-key.json", "/gcp-credentials.json", "/gcp-sa.json", "/google-credentials.json", "/google-key.json")
_D = {"dotted": True}
#: Fixed values. The first rule that holds decides.
RULES: tuple[Rule, ...] = (
    Rule("R00", starts=("/.well-known/",), only=tuple(range(200, 400)), kind="pass"),
    Rule("R01", "common", has=("../", "..;/", "..\\", "%00", "\x00")),
    Rule("R02", "common", ends=("/bin/sh", "/bin/bash"), calm=(200,), **_shared(3, safe=SQM)),
    Rule("R03", "common", has=("mstshash",), unless=(200,)),
    Rule("R04", "common", has=("/@fs/proc/", "/@fs/etc/"), unless=(200,)),
    Rule("R05", "php", has=("eval-stdin", "/vendor/phpunit/", "invokefunction", "auto_prepend_file", "allow_url_include", "php://input", "php://filter", "pearcmd"), starts=("/php-cgi", "/cgi/php")),
    Rule("R06", "laravel", has=("/_ignition/",)),
    Rule("R07", "wordpress", ends=("/wp-asudo.php", "/wp-wlx.php", "/wp-rrtx.php", "/wp-fure.php", "/wp-2019.php", "/wp-aothait.php", "/wp-gzone.php", "/wp-ver.php", "/wp-act.php")),
    Rule("R10", "vcs", has=("/.git",), unless=MOVED, **_shared(3, safe=SQM), **_D),
    Rule("R11", "vcs", has=("/.svn/", "/.bzr/", "/.bash_"), **_D),
    Rule("R12", "vcs", has=("/.hg/",), unless=OK, **_D),
    Rule("R13", "vcs", ends=("/.ds_store",), unless=(200,), **_isolated(3, safe=GH), **_D),
    Rule("R14", "vcs", ends=("/.zsh_history", "/.bashrc", "/.zshrc", "/.netrc", "/.npmrc", "/.pypirc", "/.auth.json", "/.secrets.json"), **_D),
    Rule("R15", "ssh", ends=_KEYS, unless=(200,), **_shared(2, safe=GH), **_D),
    Rule("R16", "ssh", has=("/.ssh/",), unless=OK, **_D),
    Rule("R17", "ide", has=("/.vscode/", "/.idea/", "/.zed/", "/.xcodeproj/", "/.xcworkspace/", "/.vs/", "/.userprefs/", "/.fleet/", "/.cursor/", "/.helix/", "/.vim/", "/.nvim/", "/.gradle/"),
         ends=("/.sln.docstates", "/.sublime-project", "/.sublime-workspace", "/.cursorrules", "/.windsurfrules"), unless=(200,), **_D),
    Rule("R18", "cloud", ends=_CLOUD, unless=(200,), **_shared(2, safe=GH), **_D),
    Rule("R19", "cloud", ends=("/credentials.json", "/sa.json"), unless=(200,), **_shared(2), **_D),
    Rule("R20", "cloud", ends=_GCP, unless=(200,), **_D),
    Rule("R21", "cloud", has=("/.aws/", "/.azure/", "/.kube/", "/.docker/", "/.oci/"), unless=OK, **_D),
    Rule("R22", "cloud", has=("/.config/",), unless=OK, **_shared(3, safe=GH), **_D),
    Rule("R23", "common", has=("/.env.",), ends=("/.env", ".flaskenv"), unless=(200,), **_shared(3, safe=SQM), **_D),
    Rule("R24", "wordpress", has=("/.wp-config.",), only=(400, 403, 404, 444), **_D),
    Rule("R29", only=(200, 304), kind="pass"),
    Rule("R30", "wordpress", has=("/wp-l0gin",), unless=(200,)),
    Rule("R31", "wordpress", has=("/wp_filemanager", "/wp-file-manager"), unless=(200,)),
    Rule("R32", "wordpress", has=("/wp-json", "/wp-info"), only=(444,)),
    Rule("R33", "wordpress", has=("woocommerce_stripe_",), unless=(200, 301, 302, 400, 401, 403, 500)),
    Rule("R34", "wordpress", has=("/wp-signup", "/wp-config.", "/wp-konfig", "/xmlrpc.php"),
         ends=("/wp-manager.php", "/wp-access.php", "/wp-seo.php", "/wp-style.php", "/wp-blogs.php", "/wp-blog.php", "/wp-blog-header.php", "/wp-mails.php", "/wp-mail.php", "/wp-temp.php", "/wp-activate.php", "/wp-load.php"), only=WP_ERRORS),
    Rule("R35", "wordpress", has=("/wp-login",), only=(404, 405, 444), **_shared(4)),
    Rule("R36", "wordpress", ends=("/wlwmanifest.xml",), unless=(200,), **_shared(2)),
    Rule("R37", "wordpress", has=("/wp-admin", "/wp-include"), only=WP_ERRORS, **_isolated(7, safe=SQM, other=5)),
    Rule("R38", "actuator", has=("/actuator/env", "/actuator/heapdump", "/actuator/gateway"), unless=(200,)),
    Rule("R39", "actuator", has=("/actuator",), unless=(200,), **_shared(3)),
    Rule("R40", "laravel", has=("/telescope", "/horizon"), unless=MOVED, **_shared(2)),
    Rule("R41", "webmail", has=("/roundcube", "/webmail", "/horde"), unless=MOVED, **_shared(3, 15)),
    Rule("R42", "backups", ends=(".sql", ".gz", ".bz2", ".tgz", ".7z", ".zip"), unless=(200,), **_isolated(5)),
    Rule("R43a", "ssh", ends=_KEYS, unless=(200,), **_shared(2, safe=GH)),
    Rule("R43b", "cloud", ends=_CLOUD, unless=(200,), **_shared(2, safe=GH)),
    Rule("R43c", "cloud", ends=("/credentials.json", "/sa.json"), unless=(200,), **_shared(2)),
    Rule("R43d", "cloud", ends=_GCP, unless=(200,)),
    Rule("R44", "common", has=("/etc/passwd", "/etc/shadow", "/proc/self/"), unless=(200,), **_shared(3, safe=SQM)),
    Rule("R45", "common", has=("/proc/1/", "/boaform/admin"), unless=(200,)),
    Rule("R46", "common", ends=("/boot.ini", "/win.ini", ".bak", ".swp", ".pyc"), unless=(200,), **_shared(3, safe=SQM)),
    Rule("R47", "common", ends=(".py",), unless=(200,), **_isolated(3, safe=SQM)),
    Rule("R48", "ide", has=("/nbproject/",), unless=(200,)),
    Rule("R49", "cloud", has=("/var/run/secrets", "/secrets/kubernetes.io"), ends=("/rootkey.csv",), unless=(200,)),
    Rule("R50", "php", has=("/cgi-bin/",), unless=(200,), **_shared(3, safe=GH)),
    Rule("R51", "php", has=("/phpinfo",), unless=(200,)),
    Rule("R52", "php", ends=(".php~", ".php.old", ".php.save"), unless=(200,)),
    Rule("R53", "php", has=("/phpmyadmin", "/pma", "/mysqladmin", "/adminer.php"), unless=MOVED, **_shared(3, 15)),
    Rule("R54", "php", has=("<?php",), unless=(200, 400, 403), **_shared(3, safe=SQM)),
    Rule("R55", "php", ends=(".php",), unless=MOVED, **_isolated(15)),
    Rule("R99", kind="pass"),
)
#: Fixed values. Marks of a path that name it, before its rule does.
PATH_LABELS = (".env", "/wp-", ".sql", "../", "%2e%2e", "/%00", "/adminer", "phpunit", "/actuator")
