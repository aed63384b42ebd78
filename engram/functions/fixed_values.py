"""Words, patterns, constants and formats that the results depend on.

Everything here is data.  Patterns are written once in the common subset of the
regex dialects (named groups as ``(?<name>...)``, ASCII ``\\b``); ``functions.regex``
adapts them to the JVM.
"""

# --------------------------------------------------------------------------
# Enumerated domains
# --------------------------------------------------------------------------
MEMORY_TYPES = (
    "fact", "decision", "constraint", "preference", "goal", "architecture",
    "important_event", "active_task", "temporary_state",
)

# Snapshot list name per memory type (temporary state has none).
SNAPSHOT_LISTS = {
    "fact": "facts",
    "decision": "decisions",
    "constraint": "constraints",
    "preference": "preferences",
    "goal": "goals",
    "architecture": "architecture",
    "important_event": "importantEvents",
    "active_task": "activeTasks",
}

# --------------------------------------------------------------------------
# Word lists
# --------------------------------------------------------------------------
LOW_INFO_PHRASES = (
    "ok", "okay", "k", "kk", "yes", "yep", "yeah", "yup", "no", "nope", "nah",
    "thanks", "thank you", "thx", "ty", "continue", "go on", "go ahead", "run it",
    "do that", "do it", "sure", "sure thing", "for sure", "cool", "got it", "got",
    "gotcha", "sounds", "sounds good", "sounds good to me", "that works",
    "works for me", "fine by me", "makes sense", "that makes sense", "please",
    "pls", "lgtm", "sgtm", "ack", "roger", "copy", "aye", "hm", "hmm", "huh",
    "haha", "lol", "great", "nice", "perfect", "awesome", "good", "fine", "right",
    "correct", "agreed", "absolutely", "totally", "alright", "understood", "i see",
    "no worries", "no problem", "np", "thanks a lot", "thank you very much",
    "much appreciated", "on it", "will do", "go for it", "keep going",
    "let us continue", "+", "++", "what", "why", "how", "who", "when", "where",
    "which",
)
STANDALONE_QUESTION_WORDS = (
    "what", "why", "how", "who", "whom", "whose", "when", "where", "which",
)
NOISE_WORDS = (
    "haha", "lol", "ok", "okay", "k", "kk", "yes", "yeah", "yep", "yup", "no",
    "nope", "nah", "thanks", "thank", "thx", "ty", "cool", "great", "nice",
    "good", "fine", "sure", "got", "gotcha", "lgtm", "ack", "right", "hm", "hmm",
    "huh", "please", "pls", "perfect", "awesome", "agreed", "alright",
    "understood", "works", "sounds",
)
INVALID_KEYS = (
    "what", "when", "where", "which", "who", "whom", "whose", "why", "how", "is",
    "are", "was", "were", "do", "does", "did", "can", "could", "will", "would",
    "should", "shall", "have", "has", "had", "may", "might",
)
PREFERENCE_NOISE_VALUES = (
    "this", "that", "these", "those", "it", "response", "answer", "reply",
    "message", "error", "bug", "result", "output", "suggestion", "idea",
    "solution", "explanation",
)
DEMONSTRATIVES = ("this", "that", "these", "those", "it")
KEYWORD_STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "once", "here", "there",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s",
    "t", "can", "will", "just", "don", "should", "now", "i", "me", "my", "we",
    "our", "you", "your", "he", "she", "it", "they", "them", "what", "which",
    "who", "whom", "where", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing",
)
TOPIC_STOPWORDS = (
    "we", "the", "a", "an", "to", "for", "and", "or", "of", "in", "on", "is",
    "are", "use", "using", "will", "decided", "our", "be",
)
REVOCATION_COMMON_WORDS = (
    "was", "were", "is", "are", "has", "have", "had", "been", "reset", "ignored",
    "revoked", "the", "and", "that", "this", "its", "it", "from", "to", "for",
    "with", "now", "previous", "old", "new",
)
PROJECT_PRONOUNS = (
    "it", "this", "that", "the project", "the app", "the application",
    "the product", "the system", "the platform", "the service", "we", "our",
    "the gateway", "the tool",
)
TRANSIENT_IDENTITY_WORDS = (
    "tired", "happy", "confused", "sad", "angry", "excited", "hungry", "thirsty",
    "busy", "bored", "curious", "nervous", "scared", "worried", "proud", "ashamed",
    "grateful", "hopeful", "motivated",
)
TRANSIENT_POSSESSIONS = (
    "headache", "question", "idea", "minutes", "opinion", "thought", "concern",
    "suspicion", "hunch", "feeling", "impression",
)

# Technology families used to route a preference to its domain, in test order.
UI_WORDS = ("tailwind", "mui", "shadcn", "bootstrap", "chakra", "antd")
FRONTEND_WORDS = (
    "react", "next", "next.js", "vue", "nuxt", "svelte", "sveltekit", "astro",
    "solid", "angular", "remix", "tanstack", "tanstack start",
)
LANGUAGE_WORDS = (
    "typescript", "javascript", "python", "go", "golang", "rust", "java", "kotlin",
    "swift", "c", "c++", "csharp", "php", "ruby", "dart", "lua",
)
THEME_WORDS = (
    "dark", "light", "dark mode", "light mode", "dark theme", "light theme",
)
DATABASE_WORDS = (
    "postgres", "postgresql", "mysql", "mariadb", "sqlite", "mongodb", "mongo",
    "redis", "valkey", "dynamodb", "d1", "turso", "libsql", "neon", "supabase",
    "planetscale", "cockroachdb", "cockroach", "pglite", "pinecone", "weaviate",
    "qdrant", "milvus", "faiss", "elasticsearch", "opensearch", "clickhouse",
    "upstash", "database", "db",
)
WORKFLOW_WORDS = ("agile", "scrum", "kanban", "waterfall", "sprint", "workflow")
RUNTIME_WORDS = (
    "cloudflare", "workers", "deno", "node", "nodejs", "bun", "lambda", "vercel",
    "netlify", "edge",
)
FRAMEWORK_WORDS = (
    "hono", "express", "fastify", "flask", "django", "fastapi", "spring",
    "laravel", "elysia", "bun", "node", "node.js", "deno",
)
COLOR_WORDS = (
    "red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white",
    "gray", "grey", "brown", "cyan", "magenta", "violet", "indigo", "teal", "navy",
    "maroon", "beige", "gold", "silver",
)
# (words, substrings, extra whole words, attribute, topic)
PREFERENCE_DOMAINS = (
    (UI_WORDS, ("ui library",), ("ui",), "ui_library"),
    (FRONTEND_WORDS, ("frontend", "framework"), (), "frontend_framework"),
    (LANGUAGE_WORDS, ("language",), (), "language"),
    (THEME_WORDS, ("theme", "mode"), (), "theme"),
    (DATABASE_WORDS, ("database", "db"), (), "database"),
    (WORKFLOW_WORDS, (), (), "workflow"),
    (RUNTIME_WORDS, ("runtime", "cloudflare workers"), (), "runtime"),
    (FRAMEWORK_WORDS, ("framework",), (), "framework"),
    (COLOR_WORDS, (), ("color",), "favorite_color"),
)
TECH_KEYWORDS = (
    "postgres", "postgresql", "mysql", "mariadb", "sqlite", "mongodb", "mongo",
    "redis", "valkey", "dynamodb", "d1", "turso", "libsql", "neon", "supabase",
    "planetscale", "cockroachdb", "cockroach", "pglite", "pinecone", "weaviate",
    "qdrant", "milvus", "faiss", "elasticsearch", "opensearch", "clickhouse",
    "upstash", "aws", "amazon web services", "ec2", "lambda", "s3", "cloudfront",
    "api gateway", "gcp", "google cloud", "cloud run", "cloud build", "firebase",
    "azure", "oracle cloud", "oci", "cloudflare", "workers", "pages", "r2", "kv",
    "queues", "durable objects", "vercel", "netlify", "fly.io", "render",
    "railway", "cdn", "bunny", "bunnycdn", "fastly", "akamai", "tenbyte", "minio",
    "caddy", "nginx", "traefik", "haproxy", "typescript", "javascript", "python",
    "go", "golang", "rust", "java", "kotlin", "swift", "c", "c++", "csharp",
    "php", "ruby", "dart", "lua", "react", "next", "next.js", "vue", "nuxt",
    "svelte", "sveltekit", "astro", "solid", "angular", "remix", "tanstack",
    "mui", "material ui", "shadcn", "tailwind", "bootstrap", "chakra", "express",
    "fastify", "hono", "nestjs", "django", "flask", "fastapi", "spring",
    "laravel", "elysia", "bun", "node", "node.js", "deno", "docker",
    "docker compose", "kubernetes", "k8s", "helm", "terraform", "pulumi",
    "ansible", "bullmq", "rabbitmq", "kafka", "nats", "openai", "anthropic",
    "claude", "gemini", "groq", "deepseek", "qwen", "llama", "mistral",
    "openrouter", "hugging face", "huggingface", "ollama", "vllm", "llm",
    "embedding", "embeddings", "vector", "reranker", "agent", "agents",
)

# --------------------------------------------------------------------------
# Message gates
# --------------------------------------------------------------------------
SPECULATIVE = (
    r"\b(might|maybe|perhaps|could|possibly|probably|i think|we might|considering"
    r"|not sure|unsure|tentative)\b"
)
DECISION_MARKER = (
    r"\b(decided|decision|we will|we'll|we are using|we're using|chose|chosen"
    r"|switched to|use .+ for)\b"
)
CORRECTION_MARKER = (
    r"\b(actually|correction|not\b.+\bbut\b|instead of|no longer|changed (to|from)"
    r"|switch(?:ed)? to)\b"
)
WANTS_HISTORY = (
    r"\b(used to|previously|before|old|former|was|were|history|superseded"
    r"|changed from)\b"
)
NEGATION = (
    r"\b(not|don't|do not|doesn't|did not|never|no longer|without|cannot|can't"
    r"|won't|wouldn't|isn't|is not|aren't|are not|wasn't|was not)\b"
)
USAGE_NEGATION = r"\b(not|don't|do not|doesn't|did not|never|no longer|without)\b"

QUESTION_TAIL = r"""\?\s*["']?\s*$"""
QUESTION_AUX = (
    "is|are|am|was|were|do|does|did|can|could|will|would|should|shall|have|has|had"
)
WH_AUX = (
    r"^\s*(?:what|when|where|why|who|whom|whose|how)(?:'s|'re|'d)?\s+"
    r"(?:" + QUESTION_AUX + r"|may|might|must)\b"
)
WH_CONTRACTED = r"^\s*(?:what|when|where|why|who|how)'s\b"
HOW_MODIFIER = r"^\s*how\s+(?:much|many|long|often|fast|far|come)\b"
# "what/which <1-3 words> <aux>", unless the first word is a pronoun.
WH_NOUN_AUX = (
    r"^\s*(?:what|which)\s+(?:[a-z0-9_-]+\s+){1,3}(?:" + QUESTION_AUX + r")\b"
)
WH_NOUN_PRONOUN = r"^\s*(?:what|which)\s+(?:we|i|you|they|he|she|it)\b"
# "<aux> <subject>", unless the word after the auxiliary is a negation.
INVERSION_AUX = (
    r"^\s*(?:is|are|am|was|were|do|does|did|can|could|would|should|shall)\s+"
    r"[a-z0-9_-]+\b"
)
INVERSION_NEGATED = (
    r"^\s*(?:is|are|am|was|were|do|does|did|can|could|would|should|shall)\s+"
    r"(?:not\b|n't\b)"
)
INVERSION_OTHER = (
    r"^\s*will\s+(?:we|you|they|he|she|it|i|there|this|that|the|a|an)\b"
    r"|^\s*(?:have|had)\s+(?:we|you|they|i)\b"
    r"|^\s*has\s+(?:the|it|this|that|anyone|everyone|[a-z0-9_-]+)\b"
    r"|^\s*may\s+(?:i|we)\b"
)
# What a question opening of any kind above or below begins with.
QUESTION_OPENINGS = (
    "wh", "how", "is", "are", "am", "was", "were", "do", "did", "can", "could", "would",
    "should", "shall", "will", "have", "had", "has", "may", "please", "tell", "remind", "show",
    "explain", "let", "find", "check",
)
INQUIRY_REQUEST = (
    r"^\s*(?:can\s+you\s+|could\s+you\s+|please\s+)?"
    r"(?:tell\s+me|remind\s+me|show\s+me|explain|let\s+me\s+know|find\s+out"
    r"|check\s+if|check\s+whether)\b"
)

# --------------------------------------------------------------------------
# Text normalisation
# --------------------------------------------------------------------------
SPELLINGS = (("favourite", "favorite"), ("colour", "color"), ("organise", "organize"))
APOSTROPHES = "’‘‛ʼʻ"
DOUBLE_QUOTES = "“”„‟"
CONTRACTIONS = (
    ("doesn't", "does not"), ("don't", "do not"), ("can't", "cannot"),
    ("won't", "will not"), ("isn't", "is not"), ("aren't", "are not"),
    ("wasn't", "was not"), ("weren't", "were not"), ("haven't", "have not"),
    ("hasn't", "has not"), ("hadn't", "had not"), ("didn't", "did not"),
    ("wouldn't", "would not"), ("couldn't", "could not"),
    ("shouldn't", "should not"), ("mustn't", "must not"), ("i'm", "i am"),
    ("i've", "i have"), ("i'll", "i will"), ("i'd", "i would"),
    ("you're", "you are"), ("you've", "you have"), ("you'll", "you will"),
    ("we're", "we are"), ("we've", "we have"), ("we'll", "we will"),
    ("that's", "that is"), ("it's", "it is"), ("there's", "there is"),
    ("here's", "here is"), ("what's", "what is"), ("let's", "let us"),
)
TRAILING_TEMPORAL = (
    r"\s+(?:now|these\s+days|anymore|lately|currently|today|recently)\s*$"
)
CORRECTION_PREFIX = (
    r"^\s*(?:actually[,:]?\s+|correction[,:]?\s+|no[,:]?\s+|wait[,:]?\s+"
    r"|on\s+second\s+thought[,:]?\s+|to\s+clarify[,:]?\s+|i\s+meant[,:]?\s+"
    r"|let\s+me\s+correct\s+that[,:]?\s+|scratch\s+that[,:]?\s+)"
)
# Key-like tokens and connection strings masked in free text.
SECRET_MASKS = (
    (r"\b((?:sk|pk|ghp|key|tok)[_-])[A-Za-z0-9_-]{8,}", "$1[REDACTED]"),
    (r"(?i)\b(postgresql|postgres|mysql|mongodb|redis)://[^\s\"']+", "$1://[REDACTED]"),
)

# --------------------------------------------------------------------------
# Core fact rules
# --------------------------------------------------------------------------
BUILDING = (
    r"^\s*(?:i\s+am|i'm|we\s+are|we're|building)\s+(?:building\s+)?(?<val>.+?)\s*[.!?]?$"
)
CALLED = r"\bcalled\s+(?<name>[A-Za-z0-9_-]+)"
LIVES_IN = r"^\s*(?:i\s+live|i\s+stay|i'm\s+based)\s+in\s+(?<val>.+?)\s*[.!?]?$"
IS_FROM = r"^\s*(?:i\s+am\s+from|i'm\s+from)\s+(?<val>.+?)\s*[.!?]?$"
POSSESSIVE = (
    r"^\s*(?<entity>[A-Za-z][\w\s/-]{0,30}?)'s\s+(?<attr>[A-Za-z][\w\s/-]{0,30}?)\s+"
    r"(?:is|are|was|will\s+be|has\s+been|scheduled\s+for)\s+(?<val>.+?)\s*[.!?]?$"
)
FAVORITE_IS = (
    r"^\s*(?:my\s+)?(?<kind>favorite|favourite|preferred)\s+"
    r"(?<attr>[A-Za-z][\w\s/-]{0,30}?)\s+(?:is|are|=|:)\s+(?<val>.+?)\s*[.!?]?$"
)
PREFERS = (
    r"^\s*(?:i\s+)?(?:prefer|would\s+rather|preference)\b[:\s-]*(?<choice>.+?)"
    r"(?:\s+over\s+(?<other>.+?)|\s+than\s+(?<than>.+?))?\s*[.!?]?$"
)
AFFECT = (
    r"^\s*i\s+(?:(?:do\s+not|don't|dont)\s+(?:really\s+)?(?<negVerb>like|love|enjoy|prefer)"
    r"|(?:really\s+)?(?<verb>love|like|enjoy|adore|hate|dislike))\s+(?<val>.+?)\s*[.!?]?$"
)
USES = (
    r"^\s*(?:the\s+)?(?<entity>[A-Za-z][\w\s/-]{0,30}?)\s+(?:uses|is\s+using|will\s+use)\s+"
    r"(?<val>.+?)\s*[.!?]?$"
)
THE_Y_IS_X = (
    r"^\s*(?:(?:temporary\s+detail|note|detail)\s*[:\s-]\s*)?(?:the\s+|my\s+)?"
    r"(?<attr>[A-Za-z][\w\s/-]{0,35}?)\s*(?:=| is | are | was | will\s+be |:=|:)\s*"
    r"(?<val>.+?)\s*[.!?]?$"
)
USES_LIST = (
    r"^(?<subject>.*?)\s+(?:uses|is using|will use|relies on|is built on|runs on)\s+"
    r"(?<rest>.+)$"
)
CLAUSE_SEPARATOR = r",|\band\b|\bwith\b"
AS_ROLE = r"^(?<value>.+?)\s+as\s+(?:the\s+|its\s+|our\s+)?(?<role>[a-z0-9 _-]+?)\s*$"
FOR_PURPOSE = r"^(?<value>.+?)\s+for\s+(?<purpose>.+)$"
AND_I_PREFER = r"^(?<first>.+?)\s+and\s+I\s+prefer\s+(?<second>.+)$"
SENTENCE_GAP = r"""(?<=[.;!?])\s+(?=[A-Z"'(])"""
CLAUSE_GAP = (
    r"""(?<=[.;!?])\s+(?=[A-Za-z"'(])|,\s*but\s+"""
    r"""|\s+but\s+(?=(?:now|these\s+days|currently)\b)"""
    r"""|,\s+(?=(?:and\s+)?(?:now|i|we)\b)|\s+and\s+(?=(?:i|we|my)\b)"""
)

# Attribute words that make a plain statement something other than a fact.
DECISION_ATTRIBUTE = r"\b(target|deployment|database|db|provider|stack|hosting)\b"
PLACE_PURPOSE = r"\b(project|production|staging|dev|testing)\b"

# value -> attribute, in test order
VALUE_ATTRIBUTES = (
    ("database", r"\b(turso|neon|postgres|postgresql|supabase|mysql|sqlite|libsql|mongodb"
                 r"|mariadb|dynamodb|cockroach|database|db)\b"),
    ("cache", r"\b(upstash|redis|memcached|cloudflare kv|kv store|cache)\b"),
    ("storage", r"\b(cloudflare r2|r2|s3|gcs|azure blob|minio|object storage|storage)\b"),
    ("semantic_retrieval", r"\b(embedding|embeddings|pgvector|vector|semantic retrieval"
                           r"|semantic)\b"),
    ("summarization", r"\b(groq|openai|anthropic|claude|gpt|llama|mistral|gemini|mixtral"
                      r"|summariz)\b"),
    ("framework", r"\b(hono|next|nextjs|express|fastify|nuxt|sveltekit|flask|django|spring"
                  r"|rails|fastapi)\b"),
    ("runtime", r"\b(cloudflare workers|cloudflare|workers|deno|node|nodejs|bun|lambda"
                r"|aws lambda|vercel|netlify|edge)\b"),
)
PURPOSE_ATTRIBUTES = (
    ("database", r"\b(database|db|storage\b|data)\b"),
    ("cache", r"\b(cache|redis|kv)\b"),
    ("storage", r"\b(object storage|storage|files)\b"),
    ("semantic_retrieval", r"\b(semantic|embedding|retrieval|vector)\b"),
    ("summarization", r"\b(summariz|llm|model|ai|generation|completion)\b"),
    ("framework", r"\b(framework|web framework)\b"),
    ("runtime", r"\b(runtime|hosting|deploy|platform|server|edge)\b"),
    ("technology", r"\b(api|interface|client|sdk)\b"),
)
SWITCH_VALUE_ATTRIBUTES = (
    ("database", r"\b(turso|neon|postgres|postgresql|supabase|mysql|sqlite|libsql|mongodb"
                 r"|mariadb|dynamodb|database|db)\b"),
    ("cache", r"\b(upstash|redis|memcached)\b"),
    ("storage", r"\b(cloudflare r2|r2|s3|gcs|object storage|storage)\b"),
    ("semantic_retrieval", r"\b(embedding|semantic|vector|retrieval)\b"),
    ("summarization", r"\b(groq|openai|anthropic|gpt|llama|summariz)\b"),
    ("framework", r"\b(hono|next|express|fastify|react|vue)\b"),
    ("runtime", r"\b(cloudflare workers|deno|node|bun|lambda|vercel)\b"),
)

# --------------------------------------------------------------------------
# Updates, corrections, revocations
# --------------------------------------------------------------------------
SWITCHED_FROM_TO = (
    r"^(?:we\s+|i\s+)?(?:have\s+|have\s+we\s+)?switched\s+(?<target>[\w\s/-]+?)\s+to\s+"
    r"(?<new>.+?)\s*[.!]?$"
)
SWITCHED_TO = r"^(?:we\s+|i\s+)?switched\s+to\s+(?<new>.+?)\s*[.!]?$"
SWITCH_TAIL = r"\s+(?:for|as)\s+(?:the|its|our|a|an)?\s*[a-z0-9 _/-]*$"
SWITCH_PRONOUN = r"^(it|this|that|the\s+project|the\s+app|we|our)$"

CORRECTIONS = (
    r"^(?:the\s+)?(?<target>[A-Za-z][\w\s/-]{0,30}?)\s+changed\s+from\s+(?<old>.+?)\s+to\s+"
    r"(?<new>.+?)\s*[.!]?$",
    r"^(?:the\s+)?(?<target>[A-Za-z][\w\s/-]{0,30}?)\s+(?:now\s+)?uses\s+(?<new>.+?)\s+"
    r"instead\s+of\s+(?<old>.+?)\s*[.!]?$",
    r"^i\s+changed\s+(?:my\s+)?(?<target>[A-Za-z][\w\s/-]{0,30}?)\s+from\s+(?<old>.+?)\s+to\s+"
    r"(?<new>.+?)\s*[.!]?$",
    r"^the\s+(?<target>[A-Za-z][\w\s/-]{0,30}?)\s+was\s+changed\s+to\s+(?<new>.+?)\s*[.!]?$",
    r"^the\s+(?<target>[A-Za-z][\w\s/-]{0,30}?)\s+changed\s+to\s+(?<new>.+?)\s*[.!]?$",
)
CORRECTION_PREFERENCE_TARGETS = ("preference", "my preference", "choice")
CORRECTION_DECISION_DOMAINS = (
    "database", "ui_library", "frontend_framework", "theme", "workflow",
)
REVOCATIONS = (
    r"^(?:the\s+|that\s+|this\s+|temporary\s+|previous\s+|old\s+)?(?<target>[\w\s/-]+?)\s+"
    r"was\s+reset\b",
    r"^(?:please\s+)?ignore\s+(?:the\s+)?(?:previous|old|earlier|last)\s+"
    r"(?<target>[\w\s/-]+?)\s*[.!]?$",
    r"^(?:the\s+|that\s+|this\s+)?(?<target>[\w\s/-]+?)\s+(?:is|are)\s+no\s+longer\s+valid\b",
    r"^(?:the\s+)?(?<target>[\w\s/-]+?)\s+has\s+been\s+revoked\b",
    r"^forget\s+(?:the\s+)?(?:previous|old|earlier|last\s+)?(?<target>[\w\s/-]*?)\s*[.!]?$",
)
REVOKED_VALUE = (
    r"(?:ignore|instead|forget)\s+(?:it\s+)?(?:the\s+)?(?:old\s+|previous\s+)?"
    r"""["']?(?<value>[A-Za-z0-9][A-Za-z0-9_-]{2,})["']?"""
)
REVOCATION_TOPIC = "__revocation__"

# --------------------------------------------------------------------------
# Labelled statements and the typed fallback
# --------------------------------------------------------------------------
LABEL_PREFIX = r"^\s*(?:\[(?<bracket>[a-z_ ]+)\]|(?<label>[a-z_ ]+)\s*:)\s*(?<body>.+)$"
LABEL_TYPES = {
    "fact": "fact", "facts": "fact",
    "decision": "decision", "decisions": "decision",
    "constraint": "constraint", "constraints": "constraint",
    "preference": "preference", "preferences": "preference",
    "goal": "goal", "goals": "goal",
    "architecture": "architecture",
    "important_event": "important_event", "important event": "important_event",
    "event": "important_event",
    "active_task": "active_task", "active task": "active_task",
    "task": "active_task", "todo": "active_task",
}
TYPED_STATEMENTS = (
    ("constraint", r"^\s*(?:(?:do\s+not|don't|never|must\s+not|cannot|can't|constraint)\b[:\s-]*)"
                   r"(?<body>.+)$"),
    ("preference", r"^\s*(?:i\s+)?(?:prefer|would\s+rather|preference)\b[:\s-]*(?<body>.+)$"),
    ("goal", r"^\s*(?:goal|objective|we\s+need\s+to|aim\s+to)\b[:\s-]*(?<body>.+)$"),
    ("active_task", r"^\s*(?:todo|task|working\s+on|next)\b[:\s-]*(?<body>.+)$"),
    ("important_event", r"^\s*(?:deployed|shipped|launched|released|incident)\b[:\s-]*"
                        r"(?<body>.+)$"),
    ("architecture", r"^\s*(?:architecture|stack|system\s+design)\b[:\s-]*(?<body>.+)$"),
    ("decision", r"^\s*(?:we\s+)?(?:decided(?:\s+to)?|will\s+use|are\s+using|chose|picked"
                 r"|switched(?:\s+production)?\s+to|use)\s+(?<body>.+)$"),
)
KEY_VALUE = (
    r"^\s*(?<key>[A-Za-z][\w\s/-]{0,40}?)\s*(?:=| is | are |:=|:)\s*(?<value>.+?)\s*$"
)
KEY_VALUE_PLAIN = (
    r"^(?<key>[A-Za-z][\w\s/-]{0,40}?)\s*(?:=| is | are |:=|:)\s*(?<value>.+)$"
)
DECISION_KEY = r"\b(database|db|provider|stack|hosting)\b"

# --------------------------------------------------------------------------
# Routing
# --------------------------------------------------------------------------
CONTEXT_MARKER = (
    r"\b(currently|right now|at the moment|in progress|ongoing|debugging|working on"
    r"|current (task|error|issue|bug)|the (error|issue|bug) is|is broken|temporarily"
    r"|for now)\b"
)
DURABLE_TYPES = (
    "fact", "decision", "constraint", "preference", "goal", "architecture",
    "important_event",
)
CONTEXT_KEYS = (
    ("active_debugging_context", r"\b(debug|debugging)\b"),
    ("current_error", r"\b(error|bug|exception|failed|failure)\b"),
    ("current_task", r"\b(task|working on|doing|implementing|fixing|building now)\b"),
)
DEFAULT_CONTEXT_KEY = "recent_decisions"
ERROR_TTL_SECONDS = 3600
CONTEXT_TTL_SECONDS = 7200

# --------------------------------------------------------------------------
# Scores
# --------------------------------------------------------------------------
TYPE_IMPORTANCE = {
    "decision": 0.9, "constraint": 0.88, "goal": 0.8, "architecture": 0.82,
    "preference": 0.7, "fact": 0.65, "important_event": 0.75, "active_task": 0.72,
    "temporary_state": 0.3,
}
INFO_GAIN_WRITE_THRESHOLD = 0.15
NEAR_DUPLICATE = 0.9
CORRECTION_SIMILARITY = 0.75
MERGE_STABILITY_STEP = 0.08
STABILITY_LABELS = {
    "permanent": 1.0, "long-term": 0.85, "short-term": 0.5, "session": 0.25,
}

# --------------------------------------------------------------------------
# Extended fact rules: kind -> patterns with their confidence
# --------------------------------------------------------------------------
END = r"\s*[.!?]?$"
IDENTITY_RULES = (
    ("name", r"^\s*(?:my\s+)?(?:full\s+)?name\s+is\s+(?<val>.+?)" + END, 1.0),
    ("age", r"^\s*(?:i\s+am|i'm|we\s+are|we're)\s+(?<val>.+?)\s+years?\s+old" + END, 1.0),
    ("age", r"^\s*(?:my\s+)?(?:full\s+)?age\s+is\s+(?<val>.+?)" + END, 1.0),
    ("name", r"^\s*(?:call\s+me|you\s+can\s+call\s+me|people\s+call\s+me)\s+(?<val>.+?)" + END,
     1.0),
    ("name", r"^\s*(?:my\s+)?(?:username|nickname|full\s+name)\s+is\s+(?<val>.+?)" + END, 1.0),
)
IDENTITY_ROLE = (
    r"^\s*(?:i\s+(?:am|'m|am\s+also)|we\s+are)\s+(?<val>.+?(?:student|developer|founder|engineer"
    r"|designer|architect|manager|leader|ceo|cto|pm|analyst|consultant|freelancer|teacher"
    r"|professor|doctor|nurse|lawyer|writer|artist|musician|entrepreneur))(?:\s+and\s+.+)?" + END
)
IDENTITY_PLACE_RULES = (
    ("location", r"^\s*(?:i\s+am|i'm|i'm\s+from|i'm\s+based\s+in)\s+(?<val>.+?)" + END),
    ("location", r"^\s*(?:i\s+live|i\s+stay|i'm\s+based)\s+in\s+(?<val>.+?)" + END),
    ("location", r"^\s*(?:i\s+am\s+from|i'm\s+from)\s+(?<val>.+?)" + END),
    ("age", r"^\s*(?:i\s+am|i'm)\s+(?<val>.+?)\s+(?:years?\s+old|years old)" + END),
)
OWNERSHIP_RULES = (
    (r"^\s*(?:i\s+(?:have|own|maintain|manage|run|operate)|we\s+(?:have|own|maintain|manage|run"
     r"|operate))\s+(?:a\s+|an\s+)?(?<val>.+?)" + END, 0.95),
    (r"^\s*my\s+(?<attr>.+?)\s+is\s+(?<val>.+?)" + END, 0.95),
    (r"^\s*this\s+is\s+my\s+(?<val>.+?)" + END, 0.95),
    (r"^\s*(?<val>.+?)\s+belongs\s+to\s+me" + END, 0.95),
)
USAGE_RULES = (
    (r"^\s*(?:and\s+)?(?:now\s+|currently\s+|these\s+days\s+|at\s+the\s+moment\s+|right\s+now\s+"
     r"|today\s+)?(?:i\s+(?:currently\s+)?use|i\s+am\s+using|i'm\s+using"
     r"|we\s+(?:currently\s+)?use|we're\s+using)\s+(?<val>.+?)" + END, 0.98),
    (r"^\s*(?:our\s+(?:system|team|project)\s+uses|my\s+(?:project|app|system)\s+uses)\s+"
     r"(?<val>.+?)" + END, 0.96),
)
NEGATED_USAGE_CONFIDENCE = 0.95
PAST_USAGE = (
    r"^\s*(?:i\s+(?:used\s+to\s+use|used|previously\s+used|previously\s+relied\s+on"
    r"|formerly\s+used|was\s+using|had\s+been\s+using))\s+(?<val>.+?)" + END
)
STOPPED_USAGE = (
    r"^\s*(?:i\s+stopped\s+(?:using\s+)?|i\s+no\s+longer\s+use|i\s+don't\s+use\s+anymore"
    r"|i\s+do\s+not\s+use\s+anymore|i\s+quit\s+(?:using\s+)?|i\s+abandoned"
    r"|i\s+moved\s+away\s+from|i\s+switched\s+away\s+from|i\s+replaced\s+|i\s+removed\s+"
    r"|i\s+discontinued)\s+(?<val>.+?)(?:\s+because\s+(?<reason>.+?))?" + END
)
LOCAL_PREFERENCE_RULES = (
    (r"^\s*(?:i\s+)?prefer\s+(?<val>.+?)(?:\s+over\s+(?<over>.+?))?" + END, 0.98),
    (r"^\s*(?:i\s+)?(?:really\s+)?like\s+(?<val>.+?)" + END, 0.95),
    (r"^\s*(?:i\s+)?(?:really\s+)?love\s+(?<val>.+?)" + END, 0.95),
    (r"^\s*(?:i\s+)?(?:would\s+rather\s+use|i'd\s+rather\s+use)\s+(?<val>.+?)"
     r"(?:\s+over\s+(?<over>.+?))?" + END, 0.96),
    (r"^\s*(?:i\s+)?choose\s+(?<val>.+?)(?:\s+over\s+(?<over>.+?))?" + END, 0.95),
    (r"^\s*(?:i\s+)?usually\s+choose\s+(?<val>.+?)" + END, 0.92),
    (r"^\s*(?:x|it)\s+is\s+my\s+preferred\s+(?<attr>.+?)\s+is\s+(?<val>.+?)" + END, 0.95),
)
LOCAL_DISLIKE_RULES = (
    (r"^\s*(?:i\s+don't\s+(?:really\s+)?like|i\s+do\s+not\s+(?:really\s+)?like|i\s+dislike"
     r"|i\s+hate)\s+(?<val>.+?)(?:\s+anymore|\s+any\s+more)?" + END, 0.95),
    (r"^\s*(?:i\s+never\s+use|i\s+avoid|i\s+don't\s+want\s+to\s+use|i\s+refuse\s+to\s+use)\s+"
     r"(?<val>.+?)" + END, 0.92),
    (r"^\s*i\s+am\s+not\s+a\s+fan\s+of\s+(?<val>.+?)" + END, 0.85),
)
# The value-less dislike template, used by the memory gate only.
VALUELESS_DISLIKE = r"^\s*(?:x|it)\s+is\s+not\s+for\s+me" + END
NOT_A_DISLIKE = r"\bdon't know\b|\bdon't understand\b"
FAVORITE_RULES = (
    (r"^\s*(?:my\s+)?(?:favorite|favourite)\s+(?<attr>.+?)\s+(?:is|are|=|:)\s+(?<val>.+?)" + END,
     0.98),
    (r"^\s*(?:my\s+)?(?:preferred|favourite)\s+(?<attr>.+?)\s+(?:is|are|=|:)\s+(?<val>.+?)" + END,
     0.95),
)
FAVORITE_DOMAIN = (
    r"\b(color|colour|food|language|framework|database|editor|ide|os|operating\s+system"
    r"|programming\s+language|ui\s+library|frontend\s+framework|backend\s+framework"
    r"|cloud\s+provider|hosting\s+provider|browser|game|movie|book|music|artist|tool)\b"
)
FAVORITE_DOMAIN_NAMES = {
    "color": "color", "colour": "color", "food": "food", "language": "language",
    "framework": "framework", "database": "database", "editor": "editor", "ide": "ide",
    "os": "os", "operating system": "os", "programming language": "language",
    "ui library": "ui_library", "frontend framework": "frontend_framework",
    "backend framework": "backend_framework", "cloud provider": "cloud_provider",
    "hosting provider": "hosting_provider", "browser": "browser", "game": "game",
    "movie": "movie", "book": "book", "music": "music", "artist": "artist", "tool": "tool",
}
GOAL_RULE = (
    r"^\s*(?:i\s+want\s+to|i\s+would\s+like\s+to|i'd\s+like\s+to|i\s+hope\s+to|i\s+intend\s+to"
    r"|my\s+goal\s+is\s+to|i\s+aim\s+to|i\s+need\s+to|i\s+wish\s+to)\s+(?<val>.+?)" + END
)
PLAN_RULE = (
    r"^\s*(?:i\s+plan\s+to|i'm\s+planning\s+to|i\s+am\s+planning\s+to|i\s+will\s+probably"
    r"|i'm\s+going\s+to|i\s+intend\s+to|i\s+expect\s+to|i\s+am\s+preparing\s+to)\s+"
    r"(?<val>.+?)" + END
)
POSSIBLE_PLAN_RULE = (
    r"^\s*(?:i\s+might|i\s+may|i\s+could|maybe\s+i'll|perhaps\s+i'll|i'm\s+considering"
    r"|i'm\s+thinking\s+about|i\s+am\s+thinking\s+about|i\s+may\s+decide\s+to"
    r"|i'm\s+not\s+sure\s+but|possibly|there's\s+a\s+chance\s+i'll)\s+(?<val>.+?)" + END
)
DECISION_RULE = (
    r"^\s*(?:i\s+decided\s+to|i've\s+decided\s+to|i\s+have\s+decided\s+to|i\s+chose\s+"
    r"|i\s+selected\s+|i've\s+chosen\s+|i\s+settled\s+on|we\s+decided\s+to|we\s+chose)\s+"
    r"(?<val>.+?)" + END
)
CONDITIONAL_RULE = (
    r"^\s*(?:if\s+.+\s+then\s+i\s+will|if\s+.+\s+works\s+i'll\s+use|i\s+will\s+use\s+if"
    r"|i\s+might\s+use\s+if|depending\s+on|unless\s+|provided\s+that|only\s+if)\s+"
)
CONDITIONAL_ACTION = (
    r"\b(?:will\s+use|will\s+switch|will\s+adopt|will\s+choose)\s+(?<val>.+?)" + END
)
TEMPORARY_RULE = (
    r"^\s*(?:i'm\s+testing|i'm\s+trying|i'm\s+debugging|i'm\s+currently\s+debugging"
    r"|i'm\s+experimenting\s+with|i'm\s+checking\s+|i'm\s+looking\s+at|i'm\s+reading\s+about"
    r"|i'm\s+learning\s+about)\s+(?<val>.+?)" + END
)

# Memory gate
NON_MEMORY = (
    ("greeting_or_acknowledgement",
     r"^\s*(?:hello|hi|hey|yo|sup|greetings|good\s+morning|good\s+afternoon|good\s+evening"
     r"|good\s+night)(?:\s+(?:there|folks|everyone|all|team|guys|bro|dude|man|friend))?\s*"
     r"[!.?]*$"),
    ("general_knowledge_or_coding_request",
     r"^\s*(?:what\s+is\s+|what's\s+what\s+is\s+|how\s+does\s+.+?\s+work|explain\s+|summarize\s+"
     r"|translate\s+|rewrite\s+|make\s+a\s+prompt|create\s+a\s+function|give\s+me\s+an\s+example"
     r"|search\s+for|find\s+|calculate\s+|convert\s+)\s+"),
)
INTERROGATIVE_STARTS = (
    "what", "why", "how", "when", "where", "who", "which", "should", "can", "could",
    "would", "is", "are", "do", "does", "did", "will",
)
GATE_LOW_INFO = (
    "ok", "okay", "k", "kk", "yes", "yep", "yeah", "yup", "no", "nope", "nah",
    "thanks", "thank you", "thx", "ty", "cool", "great", "nice", "good", "fine",
    "sure", "got it", "sounds good", "works for me", "makes sense", "understood",
    "perfect", "awesome",
)
GATE_KEYWORDS = (
    "use", "used", "using", "prefer", "like", "love", "hate", "dislike", "avoid", "want",
    "plan", "goal", "decided", "chose", "stopped", "no", "longer", "building",
    "creating", "developing", "working", "maintain", "learning", "own", "have", "has",
    "favorite", "preferred", "intend", "am", "name", "call", "testing", "trying",
    "switching", "migrating", "live", "living", "reside", "residing", "based", "stay",
    "staying", "hail", "from",
)

# --------------------------------------------------------------------------
# External facts
# --------------------------------------------------------------------------
ATTRIBUTE_ALIASES = {
    "name": "name", "full_name": "name", "fullname": "name",
    "occupation": "occupation", "job": "occupation", "role": "occupation",
    "profession": "occupation", "title": "occupation",
    "project": "project", "project_name": "project",
    "uses": "uses", "usage": "uses", "technology": "uses", "tech": "uses",
    "tool": "uses", "stack": "uses", "runtime": "uses", "hosting": "uses",
    "platform": "uses", "framework": "uses", "frontend": "uses",
    "frontend_framework": "uses", "cache": "uses", "caching": "uses",
    "storage": "uses", "language": "uses", "editor": "uses", "decision": "uses",
    "database": "database", "db": "database",
    "preference": "preference", "prefer": "preference", "favorite": "preference",
    "favourite": "preference", "ui_library": "preference",
    "dislike": "dislike", "avoid": "dislike", "hate": "dislike",
    "experiment": "experiment", "temporary": "experiment",
    "temporary_state": "experiment", "testing": "experiment",
    "goal": "goal", "objective": "goal", "plan": "plan",
}
USER_OWNED_ATTRIBUTES = (
    "name", "occupation", "preference", "dislike", "goal", "plan", "experiment",
)
SINGLE_VALUE_ATTRIBUTES = ("name", "occupation", "project")
EXTERNAL_TYPES = {
    "identity": "fact", "fact": "fact", "preference": "preference",
    "dislike": "preference", "favorite": "preference", "goal": "goal", "plan": "goal",
    "possible_plan": "goal", "decision": "decision", "usage": "fact",
    "past_usage": "fact", "stopped_usage": "fact", "temporary": "temporary_state",
    "event": "important_event", "action": "important_event",
    "architecture": "architecture", "constraint": "constraint",
    "active_task": "active_task",
}
EXTERNAL_STATES = {
    "current": "current", "present": "current", "past": "past", "planned": "planned",
    "future": "planned", "possible": "possible", "uncertain": "possible",
    "conditional": "conditional", "stopped": "stopped", "discontinued": "stopped",
    "superseded": "superseded",
}
TEMPORARY_HINT = (
    r"\b(?:testing|trying|experimenting|debugging|checking|looking\s+at|learning\s+about"
    r"|playing\s+with|evaluating)\b"
)
PROJECT_SCOPE_HINT = (
    r"\b(?:for\s+my\s+project|in\s+my\s+project|on\s+my\s+project|my\s+project\s+uses"
    r"|for\s+the\s+project|in\s+the\s+project|called\s+\w+|for\s+[A-Z][A-Za-z0-9_-]+)\b"
)
CONDITION_WORD = r"\b(?:if|unless|provided\s+that|depending\s+on|only\s+if)\b"
CONDITION_TEXT = r"\b(?:if|unless|provided\s+that|depending\s+on|only\s+if)\s+(?<text>.+)$"
REASON_TEXT = r"\b(?:because|due\s+to|since)\s+(?<text>.+)$"
REASON_TAIL = r"\s+(?:because|due\s+to|since)\s+.+$"
PROJECT_NAMED = (
    r"\b(?:project\s+called|building(?:\s+an?)?(?:\s+\w+)*\s+called|app\s+called|named)\s+"
    r"(?<name>[A-Z][A-Za-z0-9_-]+)"
)
PROJECT_AFTER_PREPOSITION = r"\b(?:for|in|on)\s+(?<name>[A-Z][A-Za-z0-9_-]{2,})\b"
OVER = r"^(?<value>.+?)\s+over\s+(?<other>.+)$"
THAN = r"^(?<value>.+?)\s+than\s+(?<other>.+)$"
QUESTION_START = r"^(?:what|why|how|when|where|who|which|should|can|could|would)\b"
DISLIKE_HINT = (
    r"\b(?:don'?t|do\s+not)\s+(?:really\s+)?(?:like|love|enjoy)|hate|dislike|avoid\b"
)
STOPPED_HINT = r"\bstopped\s+using\b|\bno\s+longer\s+use\b|\bdon'?t\s+use\b.*\banymore\b"
PAST_HINT = r"\bused\s+to\s+use\b|\bpreviously\s+used\b|(?:^|\b)i\s+used\b"
GOAL_LEAD = r"^(?:use|using|to\s+use|switch\s+to)\s+"
GOAL_CONDITION_TAIL = r"\s+\b(?:if|unless)\b.+$"
CONDITION_FRAGMENT = r"^(?:latency|pricing|cost|performance)\b"
DATABASE_ROLE = r"\b(?:as|for)\s+(?:the\s+)?(?:database|db)\b"
EXTERNAL_ACTIONS = ("NEW", "REINFORCE", "SUPERSEDES", "CONTRADICTS", "UPDATE", "DISCARD")
MIN_EXTERNAL_CONFIDENCE = 0.4
ENTITY_PRONOUNS_PROJECT = ("it", "this", "that", "the project", "the app", "the system", "project")
ENTITY_PRONOUNS_USER = ("we", "our", "my")

# --------------------------------------------------------------------------
# Consolidation
# --------------------------------------------------------------------------
MIN_CLUSTER_SIZE = 3
MAX_OUTPUTS_PER_CLUSTER = 2
STACK_FIELDS = {
    "language": "language", "preferred_language": "language", "database": "database",
    "preferred_database": "database", "runtime": "runtime",
    "preferred_runtime": "runtime", "hosting": "runtime", "framework": "framework",
    "preferred_framework": "framework", "frontend": "frontend",
    "frontend_framework": "frontend", "ui_library": "ui_library", "cache": "cache",
    "preferred_cache": "cache", "storage": "storage", "preferred_storage": "storage",
    "technology": "technology",
}
STACK_VALUE_FIELDS = (
    ("language", r"\b(typescript|javascript|python|golang|java|ruby|php|swift|kotlin)\b"),
    ("database", r"\b(neon|postgres|postgresql|mysql|sqlite|mongodb|turso|supabase|redis)\b"),
    ("runtime", r"\b(cloudflare|workers|deno|nodejs|bun|lambda|vercel|netlify)\b"),
    ("framework", r"\b(hono|express|fastify|next|nuxt|django|flask|fastapi)\b"),
    ("ui_library", r"\b(tailwind|mui|shadcn|bootstrap|chakra)\b"),
)
CLUSTER_TOPICS = ("user.tech_stack", "project.tech_stack")

# --------------------------------------------------------------------------
# Context compilation
# --------------------------------------------------------------------------
DEFAULT_BUDGET = 8000
EXACT_SELECTION_CELLS = 400000
MEMORY_BLOCK_TITLE = "[Project Memory & Canonical State]"
SHORT_TERM_TITLE = "[Short-Term Context (current state)]"
MEMORY_ORDINAL_BASE = 100000
KEYWORD_LIMIT = 12
KEYWORD_HITS = 40
SPARSE_HITS = 4
RECENT_HITS = 20
DURABLE_HITS = 40
EXPANSION_LIMIT = 20
SEARCH_LIMIT = 10
DEFAULT_RETRIEVE_LIMIT = 20
TOOL_OUTPUT_MAX_CHARS = 1000
TOOL_OUTPUT_HEAD_LINES = 10
RATE_LIMIT = 60
RATE_WINDOW_SECONDS = 60
INPUT_PRICE_PER_MILLION = 0.15
OUTPUT_PRICE_PER_MILLION = 0.60
