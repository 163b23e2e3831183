"""Word lists, patterns and thresholds whose content defines results."""

from __future__ import annotations

# Seniority by first match in this order, else "mid".
SENIORITY = (
    ("intern", r"\b(intern|internship|apprentice)\b"),
    ("principal", r"\b(principal|staff|distinguished|fellow)\b"),
    ("executive", r"\b(head of|director|vp|vice president|chief|cto|ceo|cfo)\b"),
    ("senior", r"\b(senior|sr\.?|lead|manager)\b"),
    ("junior", r"\b(junior|jr\.?|entry[- ]level|associate|graduate|new grad)\b"),
)
HYBRID = r"\bhybrid\b"
REMOTE = r"\b(remote|work from home|wfh|distributed|anywhere)\b"

# Salary ranges in free text.
CURRENCIES = {"$": "USD", "£": "GBP", "€": "EUR", "C$": "CAD", "A$": "AUD"}
AMOUNT = r"(\d{1,3}(?:[,.\s]\d{3})+|\d{2,3}(?:\.\d+)?\s?[kK])"
SYMBOL = r"([$£€]|C\$|A\$)?\s?"
SALARY_RANGE = SYMBOL + AMOUNT + r"\s*(?:-|–|—|to)\s*" + SYMBOL + AMOUNT
SALARY_LEAST, SALARY_MOST = 10_000, 10_000_000

# Titles that advertise recruitment, and unpaid listings.
RECRUITMENT_PHRASES = (
    "work from home",
    "work at home",
    "be your own boss",
    "unlimited income",
    "income being capped",
    "someone else s dream",
    "break free of the 9 5",
    "another way",
    "burned out from the 9 5",
    "take back control of your time",
    "earn from home",
    "financial freedom",
)
VOLUNTEER_PHRASES = ("volunteer", "unpaid intern")
VOLUNTEER_STAFF = (
    " of volunteer "
    "| volunteer (?:(?:programs?|programme|services?|resources|engagement|relations) )?"
    "(?:coordinator|manager|director|supervisor|specialist|recruiter|administrator|officer|lead|liaison) "
    "| volunteer (?:services?|engagement|relations) "
)

# Words that say nothing about a place.
LOCATION_NOISE = (
    "remote", "hybrid", "onsite", "on", "site", "usa", "us", "united", "states", "america", "or",
    "and", "the", "of", "in", "at", "area", "greater", "metro", "region", "multiple", "locations",
    "location", "various", "flexible", "anywhere", "office", "based",
)

# Technologies as (label, pattern, needs a technical title or team).
TECH_CONTEXT = (
    r"\b(engineer|engineering|developer|software|programmer|architect|devops|sre|technolog|"
    r"technical|data|analytics|scientist|backend|frontend|full[- ]?stack|platform|infrastructure)\b"
)
TECHNOLOGIES = (
    ("Python", r"\bpython\b", False),
    ("JavaScript", r"\bjavascript\b", False),
    ("TypeScript", r"\btypescript\b", False),
    ("React", r"\breact(?:\.js)?\b", True),
    ("Vue", r"\bvue(?:\.js)?\b", False),
    ("Angular", r"\bangular\b", False),
    ("Svelte", r"\bsvelte(?:kit)?\b", False),
    ("Node.js", r"\bnode\.?js\b", False),
    ("Rust", r"\brust\b", True),
    ("Golang", r"\b(?:golang|go lang)\b", False),
    ("Java", r"\bjava\b", False),
    ("Kotlin", r"\bkotlin\b", False),
    ("Swift", r"\bswift(?:ui)?\b", True),
    ("Scala", r"\bscala\b", False),
    ("Ruby", r"\bruby\b", True),
    ("Rails", r"\b(?:ruby on rails|ror)\b", False),
    ("PHP", r"\bphp\b", True),
    ("Laravel", r"\blaravel\b", False),
    ("Django", r"\bdjango\b", False),
    ("Spring", r"\bspring boot\b", False),
    (".NET", r"(?:\.net\b|\bdotnet\b)", False),
    ("C#", r"\bc#|\bc sharp\b", False),
    ("C++", r"\bc\+\+", False),
    ("Elixir", r"\belixir\b", True),
    ("Terraform", r"\bterraform\b", False),
    ("Kubernetes", r"\b(?:kubernetes|k8s)\b", False),
    ("Docker", r"\bdocker\b", False),
    ("AWS", r"\b(?:aws|amazon web services)\b", False),
    ("GCP", r"\b(?:gcp|google cloud)\b", False),
    ("Azure", r"\bazure\b", False),
    ("Snowflake", r"\bsnowflake\b", False),
    ("Databricks", r"\bdatabricks\b", False),
    ("dbt", r"\bdbt\b", True),
    ("Airflow", r"\bairflow\b", False),
    ("Kafka", r"\bkafka\b", False),
    ("Spark", r"\b(?:apache )?spark\b", True),
    ("PostgreSQL", r"\b(?:postgres(?:ql)?)\b", False),
    ("MySQL", r"\bmysql\b", False),
    ("MongoDB", r"\bmongo(?:db)?\b", False),
    ("Redis", r"\bredis\b", False),
    ("Elasticsearch", r"\b(?:elasticsearch|opensearch)\b", False),
    ("GraphQL", r"\bgraphql\b", False),
    ("Salesforce", r"\bsalesforce\b", False),
    ("HubSpot", r"\bhubspot\b", False),
    ("SAP", r"\bsap\b", True),
    ("ServiceNow", r"\bservicenow\b", False),
    ("Workday", r"\bworkday\b", False),
    ("NetSuite", r"\bnetsuite\b", False),
    ("Tableau", r"\btableau\b", False),
    ("Looker", r"\blooker\b", False),
    ("Power BI", r"\bpower ?bi\b", False),
    ("PyTorch", r"\bpytorch\b", False),
    ("TensorFlow", r"\btensorflow\b", False),
    ("LLM", r"\b(?:llm|large language model)s?\b", False),
    ("RAG", r"\brag\b", True),
    ("LangChain", r"\blangchain\b", False),
    ("CUDA", r"\bcuda\b", False),
    ("Solidity", r"\bsolidity\b", False),
    ("Unity", r"\bunity\b", True),
    ("Unreal", r"\bunreal engine\b", False),
    ("Figma", r"\bfigma\b", False),
    ("Shopify", r"\bshopify\b", False),
    ("Stripe", r"\bstripe\b", False),
    ("Twilio", r"\btwilio\b", False),
)
CASE_SENSITIVE_TECHNOLOGIES = ("dbt",)
# Links, addresses and tags, which never count as mentions.
MARKUP = r"(?:https?:)?//\S+|\bwww\.\S+|[\w.+-]+@[\w.-]+\.\w+|<[^>]*>"
# Department names that are places or modes of work.
PLACE_LIKE = r",\s*(?:[A-Z]{2}|[A-Z][a-z]+)\s*$|\b(?:remote|onsite|hybrid)\b"
# Department names that are cost-centre codes.
CODE_LIKE = r"\s-\s*\d+\s*$|^\s*\d{2,}\s*-\s"

# Path segments and host labels that are routes, never company tokens.
NOT_A_TOKEN = (
    "embed", "api", "v1", "v0", "jobs", "job", "static", "assets", "favicon.ico", "robots.txt",
    "sitemap.xml", "error", "404", "index.html", "apply", "search", "postings", "boards", "company",
    "companies", "auth", "login", "signup", "j", "oauth", "account", "settings", "terms", "privacy",
    "www", "app", "help", "support", "blog", "status", "mail", "cdn", "static1", "docs",
    "developer", "developers", "admin", "dashboard", "go", "get", "my",
)

# Corporate endings of tokens, tried in this order.
TOKEN_SUFFIXES = (
    "careers", "career", "jobs", "job", "inc", "llc", "llp", "ltd", "limited", "corp", "co",
    "group", "usa", "us", "uk", "global", "holdings", "company", "international",
)

#: Industry keys of tokens as (family, key, mode, blockers), in order of precedence.
TOKEN_KEYS = (
    ("healthcare", "veterinar", "sub", ()),
    ("healthcare", "vet", "end", ()),
    ("healthcare", "hospice", "sub", ()),
    ("healthcare", "dentist", "sub", ()),
    ("healthcare", "dental", "sub", ()),
    ("healthcare", "orthodon", "sub", ()),
    ("healthcare", "pediatric", "sub", ()),
    ("healthcare", "oncology", "sub", ()),
    ("healthcare", "surgical", "sub", ()),
    ("healthcare", "surgery", "sub", ()),
    ("healthcare", "nursing", "sub", ()),
    ("healthcare", "hospital", "sub", ()),
    ("healthcare", "clinic", "sub", ()),
    ("healthcare", "pharmac", "sub", ()),
    ("healthcare", "psychiatr", "sub", ()),
    ("healthcare", "medical", "sub", ()),
    ("healthcare", "healthcare", "sub", ()),
    ("healthcare", "homehealth", "sub", ()),
    ("healthcare", "care", "sub", ("career", "careers", "daycare", "childcare")),
    ("healthcare", "health", "sub", ()),
    ("fitness_wellness", "crossfit", "sub", ()),
    ("fitness_wellness", "fitness", "sub", ()),
    ("fitness_wellness", "pilates", "sub", ()),
    ("fitness_wellness", "yoga", "sub", ()),
    ("fitness_wellness", "wellness", "sub", ()),
    ("fitness_wellness", "gym", "sub", ("energym",)),
    ("education", "childcare", "sub", ()),
    ("education", "montessori", "sub", ()),
    ("education", "preschool", "sub", ()),
    ("education", "daycare", "sub", ()),
    ("education", "charterschool", "sub", ()),
    ("education", "school", "sub", ()),
    ("education", "academy", "sub", ()),
    ("education", "tutor", "sub", ()),
    ("education", "universit", "sub", ()),
    ("education", "college", "sub", ()),
    ("education", "campus", "sub", ()),
    ("education", "education", "sub", ()),
    ("retail_food", "restaurant", "sub", ()),
    ("retail_food", "coffee", "sub", ()),
    ("retail_food", "pizza", "sub", ()),
    ("retail_food", "burger", "sub", ()),
    ("retail_food", "brewing", "sub", ()),
    ("retail_food", "brewery", "sub", ()),
    ("retail_food", "bakery", "sub", ()),
    ("retail_food", "grocery", "sub", ()),
    ("retail_food", "foods", "sub", ()),
    ("retail_food", "retail", "sub", ()),
    ("retail_food", "salon", "sub", ()),
    ("skilled_trades", "plumbing", "sub", ()),
    ("skilled_trades", "hvac", "sub", ()),
    ("skilled_trades", "roofing", "sub", ()),
    ("skilled_trades", "landscap", "sub", ()),
    ("skilled_trades", "restoration", "sub", ()),
    ("skilled_trades", "construction", "sub", ()),
    ("skilled_trades", "contractor", "sub", ()),
    ("logistics", "logistics", "sub", ()),
    ("logistics", "freight", "sub", ()),
    ("logistics", "trucking", "sub", ()),
    ("logistics", "courier", "sub", ()),
    ("logistics", "warehouse", "sub", ()),
    ("corporate", "staffing", "sub", ()),
    ("corporate", "recruit", "sub", ()),
    ("corporate", "insurance", "sub", ()),
    ("corporate", "mortgage", "sub", ()),
    ("corporate", "realestate", "sub", ()),
    ("corporate", "realty", "sub", ()),
    ("corporate", "wealth", "sub", ()),
    ("corporate", "accounting", "sub", ()),
    ("corporate", "financial", "sub", ()),
    ("corporate", "capital", "sub", ()),
    ("corporate", "bank", "sub", ("burbank", "bankok")),
    ("corporate", "attorney", "sub", ()),
    ("corporate", "consulting", "sub", ()),
    ("corporate", "law", "sub", ("malawi", "delaware", "claw", "lawn", "lawson", "lawrence")),
    ("corporate", "legal", "sub", ()),
    ("engineering", "software", "sub", ()),
    ("engineering", "robotics", "sub", ()),
    ("engineering", "cybersec", "sub", ()),
    ("engineering", "technologies", "sub", ()),
    ("engineering", "labs", "sub", ()),
)

#: Fixed values: (family, keys) in order of precedence; keys match the padded normalised title.
#: A key with a space has its punctuation folded, as titles have; others stay as they are.
TITLE_FAMILIES = (
    ("suspect_recruitment_ad", RECRUITMENT_PHRASES),
    ("volunteer_unpaid", VOLUNTEER_PHRASES),
    (
        "ai_gig_work",
        (
            "ai trainer", "ai training", "ai tutor", "annotator",
        ),
    ),
    (
        "engineering",
        (
            "software engineer", "software developer", "backend", "back end", "back-end",
            "frontend", "front end", "front-end", "full stack", "fullstack", "full-stack", "devops",
            "site reliability", " sre", "platform engineer", "data engineer", "machine learning",
            " ml ", "ai engineer", "data scientist", "security engineer", "qa engineer",
            "test engineer", "automation engineer", "mobile engineer", "ios engineer",
            "android engineer", "ios developer", "android developer", "web developer", "programmer",
            "software architect", "solutions architect", "cloud engineer",
            "infrastructure engineer", "systems engineer", "network engineer", "firmware",
            "embedded", "developer advocate", "engineering manager", "staff engineer",
            "principal engineer", "senior engineer", "software qa", "sdet",
            "database administrator", "data analyst", "analytics engineer", "application engineer",
            "integration engineer", "api engineer", "laravel", "react", "angular", "vue ",
            "node js", "nodejs", "python", "golang", " java ", "javascript", "typescript",
            "ruby on rails", " rails ", " php ", " net ", "kotlin", "salesforce", "sharepoint",
            "servicenow", "engineering lead", "technical lead", "tech lead", "lead engineer",
            "lead developer", "product engineer", "principal software", "staff software",
            "software qa", "sre ", "devsecops", "data platform", "bioinformatic", "computer vision",
            "nlp ", "llm ", "cybersecurity", "cyber security", "penetration test", "blockchain",
            "smart contract", "game developer", "unity developer", "unreal",
            "technical program manager", "technical writer", "solution engineer",
            "forward deployed",
        ),
    ),
    (
        "engineering_nonsoftware",
        (
            "electrical engineer", "mechanical engineer", "civil engineer", "structural engineer",
            "chemical engineer", "industrial engineer", "manufacturing engineer",
            "process engineer", "quality engineer", "environmental engineer", "geotechnical",
            "petroleum engineer", "mining engineer", "aerospace engineer", "field engineer",
            "service engineer", "maintenance engineer", "project engineer", "design engineer",
            "packaging engineer", "facilities engineer", "sales engineer", "stationary engineer",
            "building engineer", "controls engineer", "safety engineer", "engineering technician",
            "cad ", "drafter", "surveyor", "architect ", "estimator",
        ),
    ),
    (
        "healthcare",
        (
            "nurse", " rn ", "rn ", "lpn", "cna ", "certified nursing", "physician", "clinician",
            "clinical", "therapist", "therapy", "caregiver", "care giver", "home health", "hha",
            "medical assistant", "pharmac", "dental", "dentist", "radiolog", "phlebotom",
            "sonograph", "respiratory", "surgical tech", "patient care", "behavioral health",
            "social worker", "psychiatr", "psycholog", "veterinar", "paramedic", "emt", "midwife",
            "optometr", "occupational health", "speech language", "dietitian", "nursing", "band 5",
            "band 6", "band 7", "band 8", "locum", "radiographer", "echocardiograph",
            "cardiac physiologist", "biomedical scientist", "audiologist", "dosimetrist",
            "vascular scientist", "accident emergency", "medical secretary", "histolog",
            "haematolog", "medical receptionist", "medical director", "medical officer",
            "telehealth", "dialysis", "podiatr", "gynecolog", "gynaecolog", "endocrinolog",
            "oncolog", "cardiolog", "dermatolog", "rheumatolog", "urolog", "anesthesiolog",
            "anaesthet", "patholog", "orthopaed", "direct support professional", "direct care",
            "bcba", "support worker",
        ),
    ),
    (
        "fitness_wellness",
        (
            "fitness instructor", "group fitness", "yoga instructor", "pilates", "barre ", "zumba",
            "spin instructor",
        ),
    ),
    (
        "education",
        (
            "tutor", "teacher", "teaching", "instructor", "educator", "paraprofessional",
            "professor", "lecturer", "curriculum", "substitute", "preschool", "childcare",
            "child care", "school psycholog", "principal ", "academic",
        ),
    ),
    (
        "skilled_trades",
        (
            "technician", "electrician", "plumber", "hvac", "welder", "mechanic", "machinist",
            "maintenance", "installer", "carpenter", "construction", "foreman", "lineman",
            "millwright", "field service", "laborer", "painter", "roofer",
        ),
    ),
    (
        "logistics",
        (
            "driver", "cdl", "warehouse", "forklift", "delivery", "courier", "picker", "packer",
            "dispatcher", "logistics", "supply chain", "fulfillment", "material handler", "loader",
            "shipping", "freight", "yard ",
        ),
    ),
    (
        "retail_food",
        (
            "sales associate", "cashier", "store manager", "retail", "barista", "cook", "server ",
            "waiter", "waitress", "bartender", "restaurant", "shift lead", "shift supervisor",
            "busser", "dishwasher", "host/hostess", "crew member", "team member", "stocker",
            "merchandiser", "housekeep", "janitor", "custodian", "security officer",
            "security guard", "front desk", "concierge", "valet", "kitchen",
        ),
    ),
    (
        "events",
        (
            "conference", "event manager", "event operations", "event producer",
            "event coordinator", "event organiser", "event executive", "event planner",
            "event specialist", "events ",
        ),
    ),
    (
        "media_production",
        (
            "journalist", "videograph", "photograph", "animator", "camera operator",
            "motion graphics", "audio engineer", "story desk", "video editor", "content editor",
            "copy editor", "managing editor", "video producer",
        ),
    ),
    (
        "sales_marketing",
        (
            "account executive", "sales", "business development", "bdr", "sdr", "marketing",
            "growth", "account manager", "customer success", "partnerships", "brand ",
            "content strategist", "seo", "demand generation", "revenue operations",
            "solutions consultant", "pre-sales", "copywriter", "communications", "public relations",
        ),
    ),
    (
        "product_design",
        (
            "product manager", "product owner", "designer", " ux", "ux ", " ui", "user experience",
            "user research", "product design", "graphic design", "creative director",
            "art director", "illustrator", "motion design",
        ),
    ),
    (
        "corporate",
        (
            "accountant", "accounting", "finance", "controller", "auditor", "tax ", "payroll",
            "recruiter", "talent acquisition", "human resources", " hr ", "people operations",
            "legal", "counsel", "paralegal", "compliance", "procurement", "office manager",
            "attorney", "lawyer", "litigation", "ediscovery", "e discovery", "document review",
            "law clerk", "investigator", "executive assistant", "administrative assistant",
            "operations manager", "project manager", "program manager", "business analyst",
            "consultant", "strategy", "chief ", "president", "vice president", "director of",
            "coordinator", "specialist", "analyst",
        ),
    ),
    (
        "support",
        (
            "customer support", "customer service", "support engineer", "technical support",
            "help desk", "helpdesk", "call center", "contact center", "client services",
        ),
    ),
    (
        "fitness_wellness",
        (
            "personal trainer", "personal training", "fitness", "kids club", "gym ",
            "membership advisor", "member experience", "spa ", "yoga", "pilates", "wellness",
            "massage",
        ),
    ),
    (
        "retail_food_generic",
        (
            "assistant manager", "general manager", "store associate", "service associate",
            "sales representative", "seasonal", "product guide", "car detailer",
        ),
    ),
    (
        "non_english",
        (
            "h f", "temps plein", "temps partiel", "vendeur", "vendeuse", "auxiliaire de vie",
            "aide a domicile", "chargé", "charge de", "responsable", "stage ", "alternance",
            "conseiller", "assistante", "technicien", "ingénieur", "ingenieur", "consultor",
            "comercial", "vaga", "analista", "gerente", "auxiliar", "estagi", "agente di",
            "commercio", "addetto", "impiegat", "operaio", "stagista", "gestor", "atendimento",
            "desenvolvedor", "ventas", "asesor", "mitarbeiter", "praktikum", "ausbildung",
            "werkstudent", "medewerker", "stagiair", "ind pendant", "ceptionniste", "pr pos",
            "t cnico", "seguran a", "chauffeur",
        ),
    ),
    (
        "engineering",
        (
            "engineer", "developer", "programmer", " devops", "software",
        ),
    ),
    (
        "generic",
        (
            "associate", "coordinator", "specialist", "assistant", "manager", "supervisor",
            "representative", "lead", "intern", "apprentice", "trainee", "clerk", "agent",
            "officer", "administrator", "operator", "attendant", "aide", "advisor", "adviser",
        ),
    ),
)
