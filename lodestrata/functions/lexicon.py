"""Word lists of the query corrector and the scanner. Results depend on them."""

# fixed values: abbreviations and what they stand for
ABBREVIATIONS = {
    "svc": "service", "repo": "repository", "ctrl": "controller", "mgr": "manager", "impl": "implementation", "iface": "interface",
    "abs": "abstract", "cfg": "configuration", "config": "configuration", "util": "utility", "utils": "utilities", "helper": "helper",
    "hlpr": "helper", "fac": "factory", "bld": "builder", "bldr": "builder", "proc": "processor", "prsr": "parser", "hdlr": "handler",
    "hndlr": "handler", "mw": "middleware", "mdlwr": "middleware", "orch": "orchestrator", "aggr": "aggregator", "db": "database",
    "dao": "data access object", "dto": "data transfer object", "orm": "object relational mapping", "qry": "query", "txn": "transaction",
    "tx": "transaction", "conn": "connection", "ds": "data source", "auth": "authentication", "authz": "authorization",
    "authn": "authentication", "jwt": "JSON web token", "oauth": "OAuth", "req": "request", "resp": "response", "res": "response",
    "api": "API", "rest": "REST", "rpc": "remote procedure call", "http": "HTTP", "ws": "web socket", "init": "initialization",
    "exec": "execute", "del": "delete", "upd": "update", "ins": "insert", "msg": "message", "evt": "event", "err": "error",
    "ex": "exception", "exc": "exception", "val": "validation", "validate": "validation", "fmt": "format", "str": "string", "num": "number",
    "id": "identifier", "pk": "primary key", "fk": "foreign key", "env": "environment", "k8s": "Kubernetes", "mq": "message queue",
    "q": "queue", "cache": "cache", "cdn": "content delivery network", "lb": "load balancer", "ha": "high availability",
    "ci": "continuous integration", "cd": "continuous deployment",
}

# fixed values: misspelt words and their correction
SPELLING = {
    "authetication": "authentication", "authentcation": "authentication", "authenticaion": "authentication", "authenication": "authentication",
    "athentication": "authentication", "authoriation": "authorization", "authorizaion": "authorization", "retreival": "retrieval",
    "retreive": "retrieve", "recieve": "receive", "reciever": "receiver", "occured": "occurred", "occurence": "occurrence",
    "seperator": "separator", "seperate": "separate", "dependancy": "dependency", "dependancies": "dependencies",
    "inheritence": "inheritance", "inheretance": "inheritance", "implemenation": "implementation", "implementaion": "implementation",
    "implemntation": "implementation", "implemantation": "implementation", "initalize": "initialize", "initalise": "initialize",
    "initalisation": "initialization", "excecution": "execution", "executoin": "execution", "exceptionn": "exception", "expetion": "exception",
    "repositry": "repository", "repostiory": "repository", "configration": "configuration", "configurtion": "configuration",
    "configuartion": "configuration", "valiation": "validation", "validaiton": "validation", "validtion": "validation",
    "transation": "transaction", "transasction": "transaction", "datatbase": "database", "databse": "database", "dbatase": "database",
    "connextion": "connection", "conneciton": "connection", "middlewear": "middleware", "middlewhere": "middleware",
    "contorller": "controller", "cotroller": "controller", "serrvice": "service", "servcie": "service", "managger": "manager",
    "managment": "management", "mangement": "management", "processer": "processor", "prcessor": "processor", "handeler": "handler",
    "hnadler": "handler", "interfce": "interface", "inteface": "interface", "funciton": "function", "functon": "function",
    "fucntion": "function", "methode": "method", "methiod": "method", "paramaeter": "parameter", "paramater": "parameter",
    "parmaeter": "parameter", "refactoring": "refactoring", "refactring": "refactoring", "inheirtance": "inheritance",
    "polymorphisim": "polymorphism", "polymorphsim": "polymorphism", "encapuslation": "encapsulation", "encapsualtion": "encapsulation",
}

# fixed values: languages by file ending
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "javascript", ".java": "java", ".go": "go",
    ".rs": "rust", ".cpp": "cpp", ".c": "c", ".cs": "c_sharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".sh": "bash", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
    ".xml": "xml", ".properties": "properties", ".gradle": "gradle", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss",
}

# fixed values: folders and files that no scan enters
SKIP_DIRS = (
    ".git .svn .hg node_modules __pycache__ .pytest_cache venv .venv env .env dist build target out .gradle .mvn logs log tmp temp "
    "generated generated-sources generated-test-sources .idea .vscode coverage .coverage migrations"
).split()
# fixed values: folders that the planning of an index leaves out besides
COMMON_SKIP_DIRS = (
    ".git .svn .hg .idea .vscode node_modules target build dist out .gradle .mvn __pycache__ .pytest_cache coverage logs log tmp temp "
    "generated generated-sources generated-test-sources"
).split()
SKIP_FILES = ["package-lock.json", "yarn.lock", "Pipfile.lock", "poetry.lock", "Cargo.lock", "go.sum"]
MAX_FILE_KB = 500

# fixed values: what each index profile takes in
PROFILES = {
    "generic": (list(LANGUAGES), [], MAX_FILE_KB),
    "spring": (".java .kt .xml .yml .yaml .properties .gradle .md .json .sql".split(), "pom.xml build.gradle settings.gradle gradle.properties".split(), MAX_FILE_KB),
    "java-library": (".java .kt .xml .yml .yaml .properties .gradle .md .json".split(), "pom.xml build.gradle settings.gradle gradle.properties".split(), MAX_FILE_KB),
    "frontend": (".js .jsx .ts .tsx .json .md .yaml .yml .html .css .scss".split(), "package.json tsconfig.json angular.json vite.config.js vite.config.ts next.config.js next.config.ts".split(), 350),
}
