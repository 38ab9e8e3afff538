"""Rule tables. All values here are fixed: results must equal those of the rules they state."""

# Relevance keywords by weight.
RELEVANCE = {
    5: ["AI Agent", "智能体", "LLM", "大模型", "GPT", "Claude", "Copilot", "具身智能", "多模态", "AIGC", "RAG", "提示词工程", "Agent", "DeepSeek", "OpenAI", "Anthropic", "月之暗面", "阶跃", "智谱", "Transformer", "注意力机制", "MoE", "混合专家"],
    3: ["AI", "人工智能", "机器学习", "深度学习", "机器人", "自动化", "NLP", "CV", "扩散模型", "文生图", "文生视频", "视频生成", "强化学习", "RLHF", "SFT", "预训练", "微调", "向量数据库", "百川", "通义", "豆包", "文心", "混元", "腾讯元宝", "推理优化", "量化", "投骰解码", "模型压缩", "ICML", "NeurIPS", "CVPR", "ACL", "EMNLP", "论文", "SOTA", "benchmark"],
    2: ["数字化转型", "智能化", "算法", "模型", "训练", "推理", "GPU", "算力", "芯片", "数据标注", "知识图谱", "联邦学习", "扩散", "生成式", "自回归", "蒸馏", "微调", "零样本"],
    1: ["科技", "互联网", "软件", "云计算", "SaaS", "开源", "产品", "创新", "创业", "融资", "IPO", "上市"],
}

# Exclusivity markers in titles, and the authority of sources.
EXCLUSIVE = [("独家", 4), ("首发", 3), ("深度", 2), ("专访", 3), ("特稿", 2), ("揭秘", 2), ("内幕", 2), ("第一手", 2), ("原创", 1), ("测评", 1), ("复盘", 2)]
AUTHORITY = {"量子位": 2.5, "机器之心": 2.5, "晚点LatePost": 2.5, "虎嗅": 2.0, "36氪": 2.0, "爱范儿": 1.5, "少数派": 1.0, "知乎日报": 0.5, "36氪快讯": 0.3, "Reddit ML": 2.5}
AUTHORITY_DEFAULT = 0.5
INTERVIEW = "专访|采访|对话|Q&A|QA|问答|观点|看法"

# Density patterns with weights (texts are in lower case), companies and structure marks.
DENSITY = [(r"[0-9]+亿", 2.0), (r"[0-9]+万", 2.0), (r"[0-9]+%", 1.5), (r"[0-9]+倍", 1.0), (r"[0-9]+亿美元", 2.5), (r"[0-9]+万元", 2.0), (r"Q[1-4]", 1.5), (r"[0-9]{4}年", 1.0), (r"第[一二三]", 1.5)]
COMPANY = r"[^\s]{2,8}(?:科技|AI|机器人|智能|数据|软件|网络|云|算力|芯片)"
STRUCTURE = r"[一二三四五六]|[1-9][0-9]*[.、）\)]|[·●◆▪▸►]"

# Event keywords by weight, and words of heat.
EVENTS = {
    5: ["WAIC", "苹果发布会", "Google I/O", "WWDC", "CES", "NeurIPS", "ICML", "CVPR", "ACL", "EMNLP"],
    3: ["发布", "推出", "上线", "开放", "公测", "融资", "上市", "收购", "合并", "最佳论文", "Oral"],
    2: ["更新", "升级", "降价", "合作", "战略", "签约", "裁员", "重组", "Spotlight"],
}
HEAT = "热议|刷屏|引爆|爆火|火了|刷爆|排队|抢购"

# Domain words, interest categories in order of priority, and technical penalties.
DOMAIN_WORDS = ["AI", "人工智能", "大模型", "GPT", "ChatGPT", "DeepSeek", "智能", "算法", "数据", "机器人", "自动驾驶", "芯片", "SaaS", "云计算", "开源", "编程", "开发者"]
INTEREST = [
    ("AI行业趋势", 5.0, ["行业分析", "产业趋势", "商业化", "商业模式", "市场规模", "融资", "上市", "财报", "战略", "竞争格局", "赛道", "风口", "独角兽", "估值", "收购", "合并", "转型", "布局", "出海", "下沉市场", "ToB", "ToC", "营收", "利润"]),
    ("AI工具与应用", 4.5, ["效率工具", "AI工具", "产品评测", "实用", "教程", "上手", "推荐", "神器", "工作流", "自动化", "插件", "浏览器", "编程助手", "代码生成", "办公", "协作", "笔记", "知识管理"]),
    ("AI创作", 4.0, ["短剧", "视频生成", "AI视频", "AI绘画", "内容创作", "AIGC", "数字人", "虚拟人", "AI写作", "AI配音", "AI音乐", "AI设计", "Stable Diffusion", "Midjourney", "Sora", "可灵", "Runway", "剪映", "即梦", "白日梦"]),
    ("效率与自动化", 3.5, ["Agent", "智能体", "自动化", "工作流", "效率提升", "NoCode", "低代码", "RPA", "API", "数据抓取", "定时任务", "推送", "Obsidian", "Notion", "飞书", "企业微信"]),
    ("科技商业", 3.0, ["互联网", "科技", "数字经济", "数字化", "平台", "生态", "用户增长", "流量", "变现", "付费", "订阅", "会员", "新消费", "电商", "直播", "短视频"]),
]
PENALTY = ["PyTorch", "TensorFlow", "CUDA", "transformer", "RNN", "CNN", "损失函数", "梯度下降", "反向传播", "激活函数", "正则化", "微调", "fine-tune", "预训练", "tokenizer", "embedding", "分布式训练", "GPU", "TPU", "显存", "量化", "推理加速", "模型压缩", "剪枝", "蒸馏", "源码", "GitHub", "代码实现", "安装教程"]

# Weights of article categories.
CATEGORY_WEIGHTS = {"AI技术": 1.0, "投资分析": 0.9, "经济趋势": 0.8, "产业研究": 0.85}
CATEGORY_DEFAULT = 0.7

# Article signals, in the order of the struct's fields.
SIGNALS = [
    ("has_methodology", "方法[论轮]|框架|模型|体系|步骤|流程"),
    ("has_framework", "框架|架构|体系|全景|路线图"),
    ("has_summary", "总结|小结|回顾|概括|综上所述"),
    ("has_case", "案例|实践|落地|实施|部署|应用"),
    ("has_data", "[0-9]+%|[0-9]+亿|[0-9]+万|[0-9]+倍"),
    ("has_quote", '"[^"]{20,}"'),
    ("has_comparison", "对比|VS|相比|不同于|区别于"),
    ("has_action", "建议|推荐|最好|应该|可以尝试|不妨"),
]
# What a signal adds to the depth score, in tenths.
DEPTH_TENTHS = {"has_framework": 10, "has_methodology": 10, "has_summary": 5, "has_comparison": 5, "has_data": 10, "has_case": 5, "has_quote": 5, "has_action": 10}
DEPTH_WORDS = ["AI", "Agent", "大模型", "LLM", "GPT", "人工智能", "智能体", "深度学习", "机器学习", "机器人", "自动化", "Copilot", "AIGC", "生成式", "提示词", "RAG"]

# Topics with their keywords, and the topic of texts without any.
TOPICS = [
    ("AI Agent与工程", ["Agent", "智能体", "Skill", "Claude", "Copilot", "自动化", "SOP"]),
    ("AI 商业与趋势", ["融资", "IPO", "上市", "估值", "赛道", "创投", "DeepSeek", "OpenAI", "Anthropic", "月之暗面", "阶跃", "智谱"]),
    ("企业数字化转型", ["数字化", "转型", "企业", "组织", "管理", "流程", "供应链"]),
    ("AI 创作与内容", ["短剧", "AIGC", "视频生成", "绘画", "音乐", "创作", "内容"]),
    ("知识管理与效率", ["知识管理", "Obsidian", "效率", "工作流", "工具", "笔记"]),
    ("人形机器人与硬件", ["机器人", "人形", "硬件", "具身智能", "AI眼镜", "触觉"]),
]
TOPIC_DEFAULT = "跨领域综合"

# Templates (id, knowledge type, keywords), domains and subdomains.
TEMPLATES = [
    ("C01-CASE", "案例", ["发布", "融资", "收购", "上市", "IPO", "裁员", "重组", "任命", "战略", "布局", "押注", "转型", "拆分", "合并", "合作", "宣布", "推出", "上线", "公测", "内测", "闭源", "开源"]),
    ("C02-INDUSTRY", "动态", ["趋势", "风向", "格局", "赛道", "展会", "大会", "峰会", "对比", "竞争", "混战", "三国杀", "谁才是", "终极", "新风向", "探展", "直击", "观察", "盘点", "年"]),
    ("C03-METHOD", "方法", ["方法论", "框架", "模型", "范式", "原理", "机制", "如何", "怎么", "指南", "教程", "最佳实践", "工作流", "思维模型", "公式", "架构", "设计模式", "算法详解"]),
    ("C04-PRODUCT", "案例", ["评测", "体验", "上手", "开箱", "测评", "实测", "工具", "插件", "App", "软件", "硬件", "设备", "产品", "参数", "性能", "跑分", "对比评测"]),
]
TEMPLATE_DEFAULT = "C02-INDUSTRY"
DOMAINS = [
    ("21-AI与智能体", ["AI", "人工智能", "大模型", "LLM", "GPT", "Claude", "Agent", "智能体", "具身智能", "机器人", "深度学习", "机器学习", "神经网络", "Transformer", "AIGC", "多模态", "RLHF"]),
    ("22-内容创作", ["短视频", "抖音", "小红书", "B站", "内容", "创作", "写作", "视频", "剪辑", "文案", "自媒体", "IP", "直播", "编剧", "剧本", "小说", "短剧"]),
    ("23-商业与管理", ["商业模式", "战略", "管理", "组织", "OKR", "KPI", "增长", "营销", "品牌", "产品经理", "运营", "SaaS", "创业", "融资", "IPO", "上市", "独角兽", "估值"]),
    ("24-金融与投资", ["投资", "基金", "股票", "A股", "港股", "美股", "量化", "交易", "理财", "保险", "银行", "支付", "加密货币", "比特币", "DeFi", "央行", "利率"]),
    ("26-信息科学与技术", ["芯片", "GPU", "算力", "云计算", "数据库", "开源", "GitHub", "编程", "代码", "架构", "系统", "网络", "安全", "隐私", "加密", "边缘计算", "IoT"]),
]
DOMAIN_DEFAULT = "21-AI与智能体"
SUBDOMAINS = {
    "21-AI与智能体": [("大模型", ["大模型", "LLM", "GPT", "Claude", "语言模型"]), ("具身智能", ["具身智能", "机器人", "人形", "四足"]), ("AI Agent", ["Agent", "智能体", "Multi-Agent"]), ("AIGC", ["AIGC", "生成", "文生图", "文生视频"]), ("AI硬件", ["芯片", "GPU", "算力", "传感器", "硬件"]), ("多模态", ["多模态", "视觉", "语音", "图像"]), ("AI+医疗", ["医疗", "诊断", "中医", "健康"]), ("AI安全", ["安全", "对齐", "红队", "越狱"])],
    "23-商业与管理": [("战略管理", ["战略", "转型", "布局", "竞争"]), ("组织管理", ["组织", "团队", "OKR", "管理"]), ("产品管理", ["产品", "PMF", "MVP", "迭代"])],
}
ENTITIES = ["OpenAI", "Anthropic", "Google", "Meta", "微软", "腾讯", "阿里", "字节", "百度", "华为", "宇树", "智元", "阶跃", "月之暗面", "百川", "智谱", "DeepSeek", "豆包", "通义", "WAIC", "ICML", "NeurIPS", "CVPR"]

# Patterns of low quality and signals of depth, for titles and summaries.
LOW_QUALITY = ["限时.*免费", "扫码.*领取", "关注.*回复", "转发.*群", "广告", "推广", "课程.*优惠", "仅需.*元", "薅羊毛", "福利", "红包"]
DEEP_SIGNALS = ["万字", "长文", "深度", "拆解", "方法论", "框架", "实践", "复盘", "指南", "手册", "白皮书", "报告", "解读", "底层", "本质", "全景", "架构", "设计", "体系", "治理"]

# Lines of code and markup, and words that only code has.
NOISE_LINES = [
    r"^\s*[.#@]?\w+[\w-]*\s*\{", r"^\s*(function|const|let|var|import|export)\s", r"^\s*(window|document|console|navigator)\.", r"^\s*\{\s*$", r"^\s*\}\s*$", r"^\s*\/\/", r"^\s*\/\*|\*\/", r"^\s*@media|@import|@keyframes", r"^\s*<\w+[^>]*>", r"^\s*;[^;]{0,10}$", r"^\s*\)\s*$", r"^\s*\}\s*\)\s*$", r"^\s*catch\b|try\b|finally\b", r"^\s*\.then\(|\.catch\(|\.finally\(", r"^\s*async\s+function", r"^\s*useState|useEffect|useCallback|useMemo", r"^\s*return\s+\{", r"^\s*export\s+default", r"^\s*Promise\.resolve|Promise\.reject", r"^\s*addEventListener\(", r"^\s*removeEventListener\(", r"^\s*setTimeout|setInterval|clearTimeout", r"^\s*\w+\.prototype\.", r"^\s*Object\.defineProperty", r"^\s*Array\.prototype|String\.prototype", r"^\s*JSON\.parse|JSON\.stringify", r"^\s*border-radius|background-color|font-size|text-align", r"^\s*position:\s*(absolute|relative|fixed)", r"^\s*display:\s*(flex|grid|block|none)",
]
URL_TOKENS = ["https", "www.", ".com/", ".html", "index.", "cdn-", ".js", ".css", ".png", ".svg"]
CODE_WORDS = ["function", "const", "let", "var", "return", "export", "import", "require", "border", "padding", "margin", "display", "position", "font-size", "color:", "background", "width:", "height:", "z-index", "opacity"]
ASCII_SENTENCE = r"^[a-zA-Z0-9\s\.\,\!\?\-\(\)\[\]\{\}\;\:]+$"

# Words that weigh in a sentence's insight, and in a thesis.
INSIGHT_WORDS = [(3, ["但是", "然而", "不过", "却", "反而", "并不", "并非", "本质上"]), (2, ["不是", "与其", "相比", "区别于", "不同于"]), (2, ["关键", "核心", "本质", "真正", "其实", "最重要", "根本原因"]), (1, ["在于", "意味着", "原因是", "背后是"])]
THESIS_WORDS = [(3, ["核心", "本质", "关键在于", "最重要", "根本", "这意味着"]), (2, ["不是", "而是", "其实", "真正", "本质上"]), (-2, ["参数", "代码", "API", "SDK", "安装", "配置", "下载"])]

# Names of frameworks.
FRAMEWORK_SUFFIX = "(?:框架|模型|体系|方法论|模式|架构|矩阵|公式|飞轮|漏斗|画布|地图|定律|法则|效应)"
FRAMEWORK_PATTERNS = [
    "(?:提出|建立|构建|形成|打造|首创|开创|称为|称之为|称作)[的]?[^。！？，,\\n]{0,10}([^\\s，,。！？；;]{2,10}" + FRAMEWORK_SUFFIX + ")",
    '[《「"](.{2,15}' + FRAMEWORK_SUFFIX + ')[》」"]',
    "([一二两三四五六七八九十百千万0-9]+(?:个|大|步|条|项|阶段|层|维度|要素|原则|策略)(?:[^\\s，。]{0,20}" + FRAMEWORK_SUFFIX + ")?)",
    "(从[\\x{4e00}-\\x{9fff}]{2,10}到[\\x{4e00}-\\x{9fff}]{2,20})",
]
FRAMEWORK_NOISE = ["http", "www", ".com", ".cn", ".org", "function", "const", "var", "let", "return", "css", "html", "javascript", "react", "vue", "style", "script", "div", "span", "class", "window", "document", "console", "element", "border", "padding", "margin", "display", "font", "color", "background", "width", "height", "position", "absolute", "relative", "{", "}", "()", "=>"]
BAD_STARTS = ["是", "在", "会", "要", "就", "也", "还", "可", "能", "有", "被", "把", "让", "给", "对", "比", "从", "到", "为", "因", "向", "按", "照", "据", "由", "与", "或", "但", "而", "且", "不过", "只是", "然后", "最后", "这个", "那个", "一个", "某个", "哪个", "什么", "推出", "发布", "采用", "宣布", "表示", "认为", "首个", "另一", "独特", "最新", "新型", "可能", "应该", "需要", "准备", "正在"]
BAD_CHARS = ["'", "「", "」", "《", "》", "（", "）", "(", ")", "/"]

# Takeaways and connections.
TAKEAWAY_TECH = ["Agent", "智能体", "AI", "大模型", "自动化", "工作流"]
TAKEAWAY_PEOPLE = ["管理", "组织", "团队", "流程", "效率", "产品", "用户"]
TAKEAWAY_STEPS, TAKEAWAY_KNOWLEDGE, TAKEAWAY_CHANGE = ("📋 方法论复制: ", "，可直接套用到工作流程设计"), ("🧩 知识入库: 「", "」可作为分析工具"), "🔄 转化思路: "
CONNECTIONS = [
    ("title", ["Agent", "智能体"], "🔗 关联知识: AI Agent 落地方法论 → 可对照 Skill 设计经验"),
    ("title", ["模型", "大模型", "LLM", "GPT"], "🔗 关联知识: 大模型产品矩阵 → 可更新工具选型笔记"),
    ("text", ["短剧", "AIGC", "视频生成"], "🔗 关联知识: AI 短剧制作 → 可补充到制作方案中"),
]

# Labels of sources, and hosts that are never fetched or checked.
SOURCE_LABELS = {"36氪": "🚀 产业快讯", "36氪快讯": "⚡ 快讯", "虎嗅": "📝 深度分析", "量子位": "🔬 AI专业", "爱范儿": "📱 产品科技", "少数派": "🛠 效率工具", "知乎日报": "💬 综合精选", "晚点LatePost": "📰 商业深度", "Reddit ML": "🌐 学术社区"}
SOURCE_LABEL_DEFAULT = "📌 其他"
SKIP_HOSTS = ["zhihu.com", "weixin.qq.com", "mp.weixin.qq.com"]
WEEKDAYS = ["一", "二", "三", "四", "五", "六", "日"]
FUNCTION_CHARS = "的了在是和有我这那不"

# What the title of a repository must contain.
AI_TOKENS = ["ai", "llm", "gpt", "agent", "ml-", "deep", "neural", "transform", "diffusion", "langchain", "rag", "vector", "embedding", "fine-tun", "chatgpt", "llama", "openai", "anthropic", "stable-diffusion"]

#: Entities that the deep read's own extractor reads, in this order.
SIMPLE_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&mdash;", "—"), ("&ndash;", "–")]
