"""Fixed values that results depend on, plainly and in natural order."""

# fixed values: words that no query counts
STOP_WORDS = (
    "the", "and", "for", "with", "a", "of", "to", "in", "is", "at", "by", "from", "on", "an", "this", "that", "these", "those", "are", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "but", "or", "as", "if", "then", "else", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "should", "now", "using", "experience", "work", "working", "knowledge", "skills", "ability", "years", "role", "team",
    "development", "engineer", "developer", "management", "systems", "solutions", "services", "infrastructure",
)

# fixed values: level of a title by the first word it contains, in this order; otherwise 2
TITLE_LEVELS = (("director", 6), ("principal", 5), ("staff", 5), ("lead", 4), ("head", 4), ("senior", 3), ("sr", 3), ("junior", 1), ("jr", 1), ("intern", 0), ("co-op", 0), ("associate", 1))
DEFAULT_LEVEL = 2

# fixed values: words that mean today where a date is expected, and month names by their first three letters
NOW_WORDS = ("present", "current", "now", "ongoing", "none", "null", "")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# fixed values: names that are none, and words of job titles
GENERIC_NAMES = ("not specified", "unknown", "n/a", "none", "unknown candidate", "null", "not specified.", "not-specified", "unspecified", "name", "candidate name", "n.a.")
TITLE_WORDS = (
    "director", "engineer", "developer", "manager", "officer", "vp", "vice president", "chief", "cto", "ceo", "cfo", "lead", "architect", "analyst",
    "administrator", "specialist", "consultant", "head", "intern", "designer", "senior", "junior", "associate", "staff", "principal",
)

# fixed values: sectors and their names
SECTORS = {
    "TECH": "Technology & Software", "FIN": "Finance & Banking", "HEALTH": "Healthcare & Life Sciences", "LEGAL": "Legal & Compliance", "REAL": "Real Estate",
    "MANU": "Manufacturing & Engineering", "COMM": "Commerce & Retail", "LOGI": "Logistics & Supply Chain", "MEDIA": "Media & Creative", "ENERGY": "Energy & Utilities",
    "EDU": "Education", "GOV": "Government & Public Sector",
}

# fixed values: words in an education that earn the bonus, by sector
EDUCATION = {
    "TECH": ("computer science", "software engineering", "data science", "artificial intelligence", "machine learning", "information technology", "electrical engineering"),
    "FIN": ("finance", "economics", "accounting", "mba", "business administration", "chartered financial analyst", "financial engineering"),
    "HEALTH": ("medical", "medicine", "nursing", "biology", "pharmacy", "pharmacology", "biochemistry", "health studies", "clinical science"),
    "LEGAL": ("law", "legal", "juris doctor", "legal studies", "criminology", "paralegal studies"),
    "REAL": ("real estate", "property development", "urban planning", "construction management", "architecture"),
    "MANU": ("mechanical engineering", "industrial engineering", "manufacturing", "chemical engineering", "materials science", "systems engineering"),
    "COMM": ("marketing", "retail", "business administration", "commerce", "supply chain management", "mba"),
    "LOGI": ("logistics", "supply chain", "operations research", "transportation management", "industrial engineering"),
    "MEDIA": ("journalism", "media studies", "communications", "graphic design", "fine arts", "cinema", "broadcasting", "creative writing"),
    "ENERGY": ("petroleum engineering", "renewable energy", "electrical engineering", "environmental science", "geology", "nuclear engineering"),
    "EDU": ("education", "teaching", "curriculum design", "pedagogy", "educational leadership"),
    "GOV": ("public policy", "political science", "public administration", "international relations", "government studies"),
}

# fixed values: degrees that earn the bonus where they stand as a word, by sector
DEGREES = {"TECH": r"\bcs\b", "FIN": r"\bcfa\b|\bmba\b", "HEALTH": r"\bmd\b|\bm\.d\.\b|\bbsn\b", "LEGAL": r"\bjd\b|\bj\.d\.\b|\bllm\b|\bll\.m\.\b"}

# fixed values: words for a good fit and for a leader, by sector
FIT_WORDS = {"TECH": ("technical fit", "tech lead profile"), "FIN": ("financial fit", "finance leader profile"), "HEALTH": ("healthcare fit", "healthcare leader profile"), "LEGAL": ("legal fit", "legal professional profile")}
OTHER_FIT = ("domain fit", "industry leader profile")

# fixed values: labels of a score
LABELS = ("Top Hidden Gem 🚀", "Solid Match 🏆", "Potential Fit ⭐", "Longshot")

# fixed values: words of a role description that show its domain, and what a search adds for the domain
DOMAIN_WORDS = {
    "Frontend": ("react", "frontend", "ui", "ux", "web", "html", "css", "client", "next.js", "svelte", "vue"),
    "Backend": ("backend", "node", "django", "fastapi", "go", "java", "api", "database", "postgres", "redis", "mongodb", "server"),
    "Machine Learning": ("ml", "machine learning", "ai", "data science", "pytorch", "tensorflow", "llm", "deep learning", "nlp", "computer vision"),
    "DevOps": ("devops", "sre", "cloud", "aws", "kubernetes", "terraform", "infrastructure", "docker", "pipeline"),
}
DOMAIN_TERMS = {
    "Frontend": (
        ("micro-frontend", "module federation", "island architecture", "component-driven architecture"),
        ("hydration mismatch", "reconciliation", "stale closure", "memory leak", "Chrome DevTools", "layout shift"),
        ("bundle splitting", "LCP", "tree-shaking", "lazy loading", "code splitting", "critical rendering path"),
        ("TypeScript generics", "React Server Components", "streaming SSR", "state management", "Next.js routing"),
    ),
    "Backend": (
        ("event-driven architecture", "domain-driven design", "CQRS", "microservices", "serverless", "distributed systems"),
        ("connection pool exhaustion", "N+1 query join", "deadlocks", "race conditions", "memory leak", "CPU bottleneck"),
        ("connection pooling", "indexing", "caching", "query optimization", "read replicas", "load balancing"),
        ("gRPC", "asyncio", "concurrency", "distributed locking", "message queues", "RabbitMQ", "Kafka", "PostgreSQL", "Redis"),
    ),
    "Machine Learning": (
        ("ML pipelines", "feature store", "model registry", "vector databases", "RAG systems", "deep learning architecture"),
        ("gradient explosion", "overfitting", "concept drift", "CUDA out of memory", "tensor dimension mismatch"),
        ("model quantization", "TensorRT", "batch inference", "GPU memory budget", "distributed training"),
        ("LLM fine-tuning", "LangChain", "embedding vectors", "reinforcement learning", "neural networks", "PyTorch", "transformers"),
    ),
    "DevOps": (
        ("infrastructure as code (IaC)", "declarative gitops", "service mesh", "high availability", "multi-region failover"),
        ("configuration drift", "pod crashloopbackoff", "network partition", "resource throttling", "liveness probe failure"),
        ("auto-scaling", "resource budget limits", "caching proxy", "load balancer latency"),
        ("Terraform modules", "Istio", "Helm charts", "Prometheus metrics", "Grafana dashboards", "ArgoCD", "Kubernetes", "AWS"),
    ),
}
# fixed values: titles of the lines that a search adds
TERM_TITLES = ("Architectures", "Debugging & Failure Modes", "Performance Optimization", "Adjacent Expertise")
# fixed values: words for the behaviour of a seniority
BEHAVIOUR = {
    "Junior": ("learning", "exposure to", "worked under", "assisted in", "monitored"),
    "Senior": ("designed", "led", "owned", "migrated", "reduced latency by", "scaled system limits", "diagnosed production issues"),
    "Lead": ("mentored", "architected", "defined standards", "drove adoption", "RFC processes", "established engineering standards", "guided junior developers"),
}
# fixed values: technologies that a description may name
TECH_STACK = ("React", "TypeScript", "Python", "Node.js", "Go", "Kubernetes", "AWS", "Terraform", "Docker", "PostgreSQL", "Redis", "FastAPI", "PyTorch", "Git", "Django", "Java", "Svelte", "Vue", "GraphQL")

# fixed values: headers of the export
EXPORT_HEADERS = ("Rank", "Candidate ID", "Name", "Current Title", "Years Experience", "Career Velocity (0-10)", "Freshness Label", "Status Label", "Semantic Score (raw)", "Education Bonus", "Final Composite Score", "Confidential Reasoning")

# fixed values: a role by the first group of words that a title contains, in this order; otherwise Other
ROLES = (("Frontend", ("frontend", "react")), ("Backend", ("backend", "api", "distributed")), ("Machine Learning", ("ml", "data scientist", "ai", "nlp")), ("DevOps", ("devops", "sre", "cloud")))

# fixed values: bands of experience
BANDS = ("Junior (<2 yrs)", "Mid (2-5 yrs)", "Senior (5-8 yrs)", "Lead/Principal (>8 yrs)")

# fixed values: states of activity
STATES = ("Active Now", "Recent", "Dormant")

# fixed values: the encoder of a sector, and that of all others
ENCODERS = {
    "TECH": "microsoft/codebert-base", "FIN": "ProsusAI/finbert", "HEALTH": "dmis-lab/biobert-base-cased-v1.2", "LEGAL": "nlpaueb/legal-bert-small-uncased",
    "REAL": "llmware/industry-bert-asset-management-v0.1", "MANU": "cea-list-ia/ManufactuBERT", "COMM": "nlptown/bert-base-multilingual-uncased-sentiment",
    "LOGI": "inovex/multi2convai-logistics-en-bert", "MEDIA": "cardiffnlp/twitter-roberta-base", "ENERGY": "Master-AI-Lab/EnergyBERT", "EDU": "vasugoel/K-12BERT",
    "GOV": "ESGBERT/GovRoBERTa-governance",
}
OTHER_ENCODER = "cross-encoder/ms-marco-MiniLM-L-6-v2"

# fixed values: sentences of the reason that is given for a score
REASONS = {
    "capped": "{name} presents {years} years of experience for a senior role; capped at 65 due to lack of deep background.",
    "stuffed": "{name} lists a dense skill set ({n_skills} skills) with a very brief resume text; penalized for potential keyword stuffing.",
    "dormant": "Exceptional {fit} ({semantic}% semantic match) — but profile dormant. High skill match, low active intent signal.",
    "top": "Elite candidate showing exceptional career velocity. {path}{skills} High-caliber {leader}.",
    "solid": "Strong matching profile. {path}{skills} Steady career progression and solid competence.",
    "potential": "Satisfactory skills align with core stack, though profile freshness or experience velocity remains moderate.{skills}",
    "longshot": "Insufficient contextual relevance or dormant profile activity makes this candidate a low-priority match.",
    "path": "Progressed from {earliest} to {title} over {years} years.",
    "no path": "Demonstrates {years} years of experience as {title}.",
    "skills": " Aligned with core requirements in {matched}.",
}

# fixed value: the flag of repeated content; the percentage is filled in
DUPLICATE_FLAG = "⚠ Duplicate content detected (%.0f%% repeated)"

# fixed values: strengths and weaknesses that fill up a comparison
STRENGTHS = ("Experience profile", "Career history progression", "Self-declared skill alignment")
WEAKNESSES = ("Profile details verification", "Missing adjacent stack elements")

# fixed value: the head of a resume in a request for many
RESUME_HEAD = "===== RESUME {n} ({file}) ====="
