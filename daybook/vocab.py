"""Controlled vocabularies. Results depend on them letter by letter."""

from __future__ import annotations

TYPES = ("project", "decision", "preference", "fact", "risk", "task", "tech", "idea")

#: Section headings and the entity types under them.
SECTION_TYPES = {
    "核心要点": "fact",
    "决策与结论": "decision",
    "已完成事项": "task",
    "待办与计划": "task",
    "用户偏好与习惯": "preference",
    "技术/项目要点": "tech",
    "风险与注意事项": "risk",
    "创意与想法": "idea",
    "关键讨论": "fact",
}
#: Line tags, the types and the task status they give.
TAG_TYPES = {
    "关键决策": "decision",
    "关键偏好": "preference",
    "关键事实": "fact",
    "关键风险": "risk",
    "关键技术": "tech",
    "已完成": "task",
    "待办": "task",
    "创意": "idea",
    "关键讨论": "fact",
}
#: Task status by tag.
TAG_STATUS = {"已完成": "completed", "待办": "todo"}
#: Titles of raw and summary subsections.
RAW_TITLES = ("原始细节", "original", "raw")
SUMMARY_TITLES = ("摘要", "summary", "digest")
#: Id prefixes; other types stand for themselves.
ID_PREFIX = {"project": "proj", "preference": "pref", "decision": "decision", "fact": "fact", "risk": "risk", "task": "task", "tech": "tech", "idea": "idea"}
#: Score weights and bases.
SCORE_WEIGHTS = {"freshness": 0.15, "frequency": 0.30, "diversity": 0.05, "richness": 0.05, "access": 0.10, "type_base": 0.35}
TYPE_BASE = {"decision": 0.80, "risk": 0.60, "project": 0.50, "preference": 0.40, "task": 0.15, "tech": 0.05}
#: Unordered pairs of types linked by standing in one section.
CO_OCCURRENCE = (
    ("decision", "risk"),
    ("decision", "project"),
    ("decision", "preference"),
    ("risk", "project"),
    ("risk", "preference"),
    ("project", "preference"),
    ("project", "task"),
    ("decision", "task"),
    ("risk", "task"),
    ("idea", "project"),
    ("idea", "decision"),
)
#: Limits of the gates, of links a file, of embedding batches, of names sought in texts.
PROJECT_MIN_DAYS = 2
PROJECT_GRACE_DAYS = 14
MAX_RELATIONS_PER_FILE = 500
EMBEDDING_BATCH = 10
EMBEDDING_DIMENSION = 1024
MIN_PROJECT_NAME = 3
#: Project names too general to search for inside other texts.
PROJECT_BLOCKLIST = ("项目", "系统", "服务", "Project", "System")
#: Stopwords that can be tokens of two letters or more.
STOPWORDS = (
    "the an and or of to in on at for by with from as is are was were be been being have has had do does did "
    "will would could should may might shall it its this that these those we our you your they them he she his her "
    "not no nor but if so what which who how when where why about into over after before between under above"
).split()
#: Keywords of opposing stances.
STANCES = (
    (("采用", "选择", "决定使用", "改用"), ("放弃", "排除", "不采用", "弃用")),
    (("增加", "新增", "添加", "引入"), ("移除", "删除", "去掉", "废弃")),
    (("升级", "更新到", "迁移到"), ("回退", "降级", "回滚到")),
)
#: Evidences of links that are no longer made.
WEAK_EVIDENCES = (
    "核心要点",
    "决策与结论",
    "已完成事项",
    "待办与计划",
    "用户偏好与习惯",
    "技术/项目要点",
    "风险与注意事项",
    "创意与想法",
    "技能管理",
    "Agent 连通性测试与 Auto-Announce Bug 排查",
)
#: Names and texts that are never knowledge.
GARBAGE_NAMES = ("", "无", "是", "否", "沟通直接", "确认", "-", "潜在", "暂缓", "制定", "事项", "恢复", "行", "任务", '"', "）", "（", "、", "。", "，")
#: Item texts left by the note-taking process itself.
GARBAGE_PATTERNS = (
    "摘要失败",
    "见日志",
    "-ERR:",
    "心跳",
    "(?i:heartbeat)",
    "本次对话(仅|无|只)",
    "无(任何)?实质(性)?(内容|进展|输入)",
    "(仅|只)包含.*(系统|心跳|轮询|检查)",
    "本时段无(提取|实质)内容",
    "本地提取无输出",
    "(磁盘|内存)(使用|空间).*\\d+(%|G|GB|MB)",
    "pending 子会话",
    "DAILY 检查",
)
#: Words of operations logs; clock times, durations and signs that are no names.
OPS_KEYWORDS = "(?i)(?:cron|backup|dreaming|daily.memory|crontab|UTC\\d{1,2}:\\d{2})"
CLOCK_UTC = "^\\d{1,2}:\\d{2}\\s+UTC"
CLOCK_BRACKET = "^\\[\\d{1,2}:\\d{2}\\]"
DURATION = "^[\\d\\-~至到]+[hHdDwW月年天周）)]?$|^[\\d.]+\\s*[hHdDwW月年天周]$"
NAME_PUNCTUATION = "^[（）()\"'\\[\\]{}【】，。！？、；：…·*]+$"
#: Technical words too general to keep.
TECH_COMMON = "AI API LLM CLI UTC JSON YAML HTML HTTP SQL URL CSS XML SSH SSL TLS DNS CPU GPU RAM SSD OS IP TCP UDP".split()
#: Dates and priorities, and English words, that only look like terms.
TECH_STRUCTURAL = "^(?:\\d{4}[_-]\\d{2}(?:[_-]\\d{2})?|P[0-3])$"
TECH_ENGLISH = "the and for are was all can has had not but our you his her its who how new now one two ten get set put use".split()
#: The six patterns of technical terms in their order, with the least length.
TECH_PATTERNS = (
    ("`([a-zA-Z][\\w./_-]+)`", 2),
    ("\\b([\\w-]+\\.(?:py|js|ts|rs|go|java|rb|sh|yaml|yml|json|toml|cfg|conf|sql|md))\\b", 2),
    ("(?<=[一-鿿，。；：、！？　])([A-Z][a-zA-Z0-9]{1,20})(?=[一-鿿，。；：、！？　])", 2),
    ("\\b([A-Z][A-Z0-9]{1,7})\\b", 2),
    ("\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b", 4),
    ("(?:(?<=^)|(?<=[\\s(\\[，。；:、]))([A-Za-z][A-Za-z0-9]*[._-]?\\d+(?:\\.\\d+)*[a-z]*)(?=[\\s)\\]，。；:、]|$)", 3),
)
#: The three patterns of project names, the verbs before them, and what no
#: project name holds.
PROJECT_PATTERNS = ("([A-Z][A-Za-z0-9]+)\\s*项目", "([一-鿿]{2,12})项目", "\\b([A-Z][\\w]+)\\s+[Pp]roject\\b")
PROJECT_VERBS = ("启动", "完成", "决定", "开始", "上线", "推进", "继续", "完成了")
PROJECT_STRUCTURAL = ("基于", "作为", "采用", "使用", "通过", "包含", "利用", "按照", "针对", "关于")
PROJECT_NON_NAME = "的了为而非是这那个全部所必须按把被与和或让使其此即则等着过得无有归匹配声称完倾向强调修改注立成类该项偏"
#: Patterns of decisions, preferences, risks and tasks, and how a clause ends.
CLAUSE = "(?:[，,。；;]|$)"
DECISION_PATTERNS = (f"决定(.+?){CLAUSE}", "采用(.+?)方案", f"放弃(.+?){CLAUSE}", f"选择(.+?){CLAUSE}")
PREFERENCE_PATTERNS = (f"用户(?:偏好|倾向|喜欢|习惯)(.+?){CLAUSE}", f"用户要求(.+?){CLAUSE}")
RISK_PATTERNS = ("(.+?)风险", "(.+?)注意", "(.+?)避免", "(.+?)可能导致(.+)")
DONE_PATTERNS = (f"完成了(.+?){CLAUSE}", f"实现了(.+?){CLAUSE}", f"部署了(.+?){CLAUSE}", f"已(?:完成|实现|部署)(.+?){CLAUSE}")
TODO_PATTERNS = (f"后续(.+?){CLAUSE}", f"计划(.+?){CLAUSE}", f"预计(.+?){CLAUSE}", f"待(?:办|完成|处理)(.+?){CLAUSE}")
#: Signs that no term has.
CJK_SIGNS = "[、，。：；！？「」『』《》（）()…—·]"
