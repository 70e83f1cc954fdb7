"""Word lists, tables and patterns that results depend on."""

from __future__ import annotations

#: Code-point ranges of CJK text, as the inside of a regular-expression class. Fixed values.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
#: White space as Unicode and Python see it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: What ends a sentence. Fixed values.
TERMINATORS = "。！？!?;\n"

#: ASCII stop words. Fixed values.
STOP_WORDS = (
    "the a an of is are was were to and or in on for that this it as with by be at from "
    "which but not have has had will would can could"
).split()
#: CJK stop characters. Fixed values.
STOP_CHARACTERS = list("的了是在和与就都而及或也有被把对为以之其这那")

#: Thesaurus: CJK key, English terms; in the order in which they are declared. Fixed values.
THESAURUS: dict[str, list[str]] = {
    "线程": ["thread", "threads"],
    "线程数": ["thread count", "threads", "n_threads"],
    "小模型": ["small model", "quantised", "quantized"],
    "推理": ["inference", "decoding"],
    "吞吐": ["throughput", "tokens per second"],
    "核心": ["core", "cores", "cpu count"],
    "量化": ["quantised", "quantized", "int8"],
    "检索": ["retrieval", "retriever", "search"],
    "召回": ["recall", "retrieve"],
    "融合": ["fusion", "fuse", "rrf", "reciprocal rank fusion"],
    "排名": ["rank", "ranking"],
    "重排": ["rerank", "reranker", "reranking", "cross-encoder"],
    "交叉编码器": ["cross-encoder", "cross encoder"],
    "归一化": ["normalisation", "normalization", "min-max"],
    "分块": ["chunk", "chunks", "chunking"],
    "索引": ["index", "indexing"],
    "语料": ["corpus", "document set"],
    "文档": ["document", "documents", "passage"],
    "停用词": ["stopword", "stopwords"],
    "阈值": ["threshold", "floor"],
    "接地": ["grounding", "grounded"],
    "核验": ["verify", "verification", "check"],
    "幻觉": ["hallucination", "hallucinated", "fabricated"],
    "证据": ["evidence", "support"],
    "断言": ["claim", "assertion", "sentence"],
    "路由": ["route", "routing", "router"],
    "确定性": ["deterministic", "deterministic routing"],
    "计算器": ["calculator", "arithmetic"],
    "算术": ["arithmetic", "expression"],
    "单位": ["unit", "conversion"],
    "复现": ["reproducible", "reproducibility", "deterministic"],
    "依赖": ["dependency", "dependencies", "lock"],
    "锁定": ["lock", "pinned", "pin", "freeze"],
    "干净环境": ["clean environment", "clean room", "fresh install"],
    "单元测试": ["unit test", "unit tests", "test suite"],
    "端到端": ["end-to-end", "e2e", "integration"],
    "锁文件": ["lockfile", "requirements.lock", "freeze"],
    "哈希": ["hash", "hashing", "blake2b"],
    "评估": ["evaluation", "eval", "metrics"],
    "排序": ["ranking", "order", "ordering"],
}

#: Metres and kilograms to a unit; temperature scales by name. Fixed values.
METRES = {
    "m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mile": 1609.344, "miles": 1609.344, "ft": 0.3048, "feet": 0.3048,
    "inch": 0.0254, "in": 0.0254, "yd": 0.9144, "海里": 1852.0, "nm": 1852.0,
}
KILOGRAMS = {
    "kg": 1.0, "g": 0.001, "mg": 1e-06, "t": 1000.0, "ton": 1000.0, "lb": 0.45359237, "lbs": 0.45359237,
    "oz": 0.028349523125, "斤": 0.5,
}
SCALES = {"degc": "C", "degf": "F", "c": "C", "f": "F", "k": "K", "kelvin": "K"}

#: Routing words and patterns. Fixed values.
MATH_WORDS = ["计算", "算一下", "等于多少", "的结果", "what is", "calculate", "compute"]
MATH_TRIM = " \t=?:.。！？，、；;!！　"
UNIT_QUESTION = r"(?i)(\d+(?:\.\d+)?)\s*([A-Za-z]{1,6})\s*(?:to|->|=>|in|转|换|换算成|等于|=)\s*([A-Za-z]{1,6})"
UNIT_WORDS = ["convert", "to", "转", "换", "="]
DATE_QUESTION = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
DATE_WORDS = ["相差", "间隔", "多少天", "几天", "距离", "days between", "diff", "相差几天"]

#: Provenance marks that are no claims. Fixed values.
CITATION = r"[（(]\s*(?:依据|来源|出处|source|citation)\s*[:：][^）)]*[）)]"
CITATION_ID = r"\[[A-Za-z0-9_.\-]+#\d+\]"
HEDGES = ["证据不足", "无法", "根据已有资料，最相关"]
NO_ANSWER = "证据不足，无法回答该问题。"

#: Notes in traces, answers of tools, marks of observations, and probe questions. Fixed values.
STEP_NOTE = "step {}: "
UNPARSABLE_NOTE = "step {}: unparsable model output, stopping"
BUDGET_NOTE = "step budget of {} exhausted"
ERROR_MARK = "ERROR: "
NO_MATCH = "no documents matched the search"
ROUTE_NOTE = "deterministic route: "
ROUTE_FAILED_NOTE = "deterministic route failed: "
NO_RESULT = "无法计算结果："
SEARCH_THOUGHT = "Thought: 现有证据不足，先扩展检索。"
PROBES = ["12*(3+4)+18/3", "计算 12*(3+4)+18/3 等于多少？", "(128+64)/8-100", "2^10"]

#: Pictograph ranges, as the inside of a regular-expression class. Fixed values.
PICTOGRAPHS = (
    r"\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{1F000}-\x{1F02F}\x{1F0A0}-\x{1F0FF}"
    r"\x{1F100}-\x{1F1FF}\x{1F200}-\x{1F2FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{200D}\x{20E3}\x{E0020}-\x{E007F}"
)
