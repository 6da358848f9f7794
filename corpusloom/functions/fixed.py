"""Word lists, lookup tables, patterns and text formats.

Results depend on these values being exactly what they are, so they stand here
as plain data, in one place. Nothing in this module does any work. Every table
can be replaced through the parameters of the operators that use it.
"""

# --------------------------------------------------------------------------
# Cleaning patterns, written for java.util.regex.
# Word characters and white space are spelled out because \w and \s are
# ASCII-only there. Classes are nested with the usual characters first: the
# engine tries the parts of a class in turn, inner ones last, and so decides
# most characters after one comparison.
# --------------------------------------------------------------------------
WORD = r"[a-zA-Z0-9_[\p{L}\p{N}]]"
SPACE = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
NONSPACE = (r"[!-~[\x{a1}-\x{167f}[\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}"
            r"\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}"
            r"\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]]]")
WORD_EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# A name begins at the first word character of its run, or right behind the
# address before it. Saying so, and giving nothing back, keeps it linear on long
# runs; what stands before a name, group 1, stays.
EMAIL = (rf"(?:(?<![.+\-{WORD}])([.+\-]*+)(?={WORD})|\G(?<={WORD})(?=[.+\-]))"
         rf"[.+\-{WORD}]++@[\-{WORD}]+\.[a-zA-Z]{{2,}}{WORD_EDGE}")
PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}{SPACE}\-(). ]{{7,}}\p{{Nd}}"
# The last branch can only ever start at the head of a run of non-blanks;
# saying so keeps it linear on very long runs.
URL = (rf"(?iu)https?://{NONSPACE}+|www\.{NONSPACE}+|(?<!{NONSPACE})"
       rf"{NONSPACE}+\.(?:com|org|net|io|edu|gov){NONSPACE}*")
# Cheap sign that a text may hold an address at all; every text matched by
# EMAIL or URL is matched by it too.
ADDRESS_SIGN = r"@|://|[wW]\.|\.[cCoOnNiIeEgGİı]"
YEARS = (rf"(?<!\p{{Nd}})(\p{{Nd}}++)\+?[{SPACE}]*"
         r"(?:years?|yrs?)")

# --------------------------------------------------------------------------
# Stop words.
# --------------------------------------------------------------------------
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before
after above below to from up down in out on off over under again then once here
there when where why how all both each few more most other some such no nor not
only own same so than too very can will just don should now ain couldn didn
doesn hadn hasn haven isn mightn mustn needn shan shouldn wasn weren won wouldn
s t d ll m re ve y
""".split()

# Fused words that the word tokenizer takes apart.
FUSED_WORDS = [("can", "not"), ("gim", "me"), ("gon", "na"),
               ("got", "ta"), ("lem", "me"), ("wan", "na")]

# Noun endings and what they may be replaced by, in order.
NOUN_ENDINGS = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"),
                ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
                ("men", "man"), ("ies", "y")]

# --------------------------------------------------------------------------
# Suffix rules of the published Porter (1980) algorithm, as
# (suffix, replacement) pairs in the order they are tried.
# --------------------------------------------------------------------------
PORTER_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"),
    ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
PORTER_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"),
                ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
PORTER_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant",
                "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
                "ous", "ive", "ize"]
# Words whose stem is looked up instead of computed.
PORTER_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie",
    "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# --------------------------------------------------------------------------
# Skill dictionary, domain -> phrases.
# --------------------------------------------------------------------------
SKILLS = {
    "data_science": [
        "python", "r", "machine learning", "deep learning", "tensorflow",
        "pytorch", "scikit-learn", "pandas", "numpy", "statistics", "nlp",
        "computer vision", "sql", "tableau", "spark"],
    "web": [
        "javascript", "typescript", "react", "angular", "vue", "node", "html",
        "css", "webpack", "graphql", "redux"],
    "backend": [
        "python", "java", "django", "flask", "fastapi", "spring",
        "microservices", "docker", "kubernetes", "aws", "azure", "postgresql",
        "mysql", "mongodb", "redis", "kafka"],
    "devops": [
        "docker", "kubernetes", "jenkins", "terraform", "ansible", "aws",
        "azure", "linux", "bash", "prometheus", "grafana"],
    "java": ["java", "spring", "hibernate", "maven", "gradle", "junit", "jpa"],
    "testing": ["selenium", "pytest", "junit", "cucumber", "jira", "postman"],
}

# Category -> title.
TITLES = {
    "Data Science": "Senior Data Scientist / ML Engineer",
    "Python Developer": "Python Software Engineer",
    "Java Developer": "Java Backend Engineer",
    "Web Designing": "Frontend / Full-Stack Developer",
    "DevOps Engineer": "DevOps / Platform Engineer",
    "Network Security Engineer": "Cybersecurity Engineer",
    "Database": "Database Engineer / DBA",
    "DotNet Developer": ".NET Software Engineer",
    "Blockchain": "Blockchain Developer",
    "Testing": "QA Automation Engineer",
    "Automation Testing": "SDET / Automation Engineer",
    "ETL Developer": "Data / ETL Engineer",
    "Hadoop": "Big Data Engineer",
    "HR": "HR Business Partner",
    "Sales": "Sales Account Executive",
    "Mechanical Engineer": "Mechanical Design Engineer",
    "Civil Engineer": "Civil / Structural Engineer",
    "Electrical Engineering": "Electrical Systems Engineer",
}

# Titles for categories without one, first match wins.
TITLE_BY_SKILL = [
    (["machine learning", "deep learning", "tensorflow"],
     "Data Scientist / ML Engineer"),
    (["react", "angular", "vue", "javascript"],
     "Frontend / Full-Stack Developer"),
    (["django", "flask", "fastapi", "spring"], "Backend Software Engineer"),
    (["docker", "kubernetes", "terraform"], "DevOps / Platform Engineer"),
]
DEFAULT_TITLE = "Software Engineer"

# --------------------------------------------------------------------------
# Document templates. The key None is the default entry.
# --------------------------------------------------------------------------
SUMMARIES = {
    "Data Science":
        "We are looking for a data-driven {title} who turns raw data into "
        "products. You will own the full ML lifecycle: data, experiments, "
        "models in production, and monitoring.",
    "Python Developer":
        "We need a sharp {title} who writes clean, tested Python and cares "
        "about code quality, performance, and maintainability.",
    "Java Developer":
        "We are hiring a {title} to build high-throughput backend services. "
        "You will own microservices, APIs, and data pipelines in a "
        "cloud-native environment.",
    "Web Designing":
        "We want a creative {title} who turns designs into fast, accessible "
        "web experiences — from wireframe to production CSS.",
    "DevOps Engineer":
        "We need a {title} who lives and breathes automation: CI/CD, "
        "infrastructure-as-code, and observability from day one.",
    "Testing":
        "We are looking for a quality-obsessed {title} to build test suites "
        "that give the whole team confidence to ship at speed.",
    "HR":
        "We are looking for a people-first {title} to drive talent "
        "acquisition, onboarding, and employee engagement.",
    None:
        "We are looking for a talented {title} with {years}+ years of "
        "experience to join our growing engineering team.",
}

RESPONSIBILITIES = {
    "Data Science": [
        "Design, train, and evaluate ML/DL models end-to-end",
        "Build and maintain feature pipelines and data workflows",
        "Collaborate with product and engineering on experiment design",
        "Monitor model drift and own retraining cycles",
        "Document findings and present results to stakeholders"],
    "Python Developer": [
        "Write clean, tested, and well-documented Python code",
        "Design and maintain REST APIs and backend services",
        "Review pull requests and mentor junior developers",
        "Identify and fix performance bottlenecks",
        "Participate in system design discussions"],
    "Java Developer": [
        "Build and maintain high-performance Java microservices",
        "Design RESTful APIs consumed by web and mobile clients",
        "Write unit and integration tests with high coverage",
        "Optimise database queries and caching strategies"],
    "DevOps Engineer": [
        "Design and maintain CI/CD pipelines for multiple teams",
        "Manage cloud infrastructure using Terraform / Ansible",
        "Own observability stack: metrics, logs, and alerting",
        "Harden security posture and manage access controls"],
    None: [
        "Design, develop, and deliver features in a cross-functional team",
        "Write clean, well-tested, and documented code",
        "Participate in architecture discussions and code reviews",
        "Mentor junior engineers and share technical knowledge"],
}

OFFERS = {
    "Data Science": [
        "Access to cutting-edge GPU compute",
        "Conference and publication budget",
        "Flexible remote / hybrid schedule",
        "Competitive salary and equity"],
    None: [
        "Competitive, market-benchmarked salary and annual bonus",
        "Flexible remote / hybrid work",
        "Annual learning and development budget",
        "Health, dental, and vision coverage"],
}

# Line formats of the document.
RULE = "─" * 50
BULLET = "  - "
HEADINGS = {"title": "JOB DESCRIPTION: ", "summary": "SUMMARY",
            "responsibilities": "RESPONSIBILITIES",
            "requirements": "REQUIREMENTS", "stack": "TECH STACK",
            "offers": "WHAT WE OFFER"}
YEARS_LINE = "+ years of hands-on professional experience"
NO_SKILL_LINE = "Strong software engineering fundamentals"
CLOSING_LINES = ["Solid understanding of software design principles",
                 "Experience working in agile / scrum teams"]
NO_STACK = "General technical skills"

# The instruction text of a generation prompt.
PROMPT_HEAD = ("You are an expert technical recruiter.\n"
               "Write a professional job description for the role this "
               "resume fits best.\n")
PROMPT_BODY = ("\n\nInclude: Job Title, Summary (2-3 sentences), "
               "Responsibilities (5 bullet points), Requirements (5 bullet "
               "points), Tech Stack, and Benefits. Be specific — do not "
               "repeat any phrase twice.\n\nResume:\n")
PROMPT_CHARS = 3000

# The two columns of a corpus file, and where one may lie.
CSV_CATEGORY, CSV_TEXT = "Category", "Resume"
CSV_PATHS = ("ResumeDataSet.csv", "../ResumeDataSet.csv",
             "data/ResumeDataSet.csv")

# Cells that a CSV reader takes for a missing value.
CSV_MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN",
               "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
               "NULL", "NaN", "None", "n/a", "nan", "null"]
