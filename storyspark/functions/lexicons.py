"""Keyword lists of the default lexicons.

Everything in this file is a fixed value: keywords, patterns, labels and sentences that results must
equal. Order matters (ties go to what comes first) and repeated keywords count twice.
"""

# Chapter titles, at the start of a stripped line.
TITLE_PATTERNS = [
    r"第[一二三四五六七八九十百千零\d]+章[\s:：]",
    r"第[\d]+章[\s:：]",
    r"Chapter[\s]*[\d]+",
    r"[\d]+[\s:：]",
    r"[\(（]?[\d]+[\)）]?[\s:：]",
]
JUNK_PATTERNS = [
    "本书由.+整理", "VIP章节请订阅", "正版订阅在阅文", "起点中文网", "QQ阅读", "手机用户请到.+阅读",
    "请记住本书首发域名", "笔趣阁", "小说网", r"www\..+\.com",
]
METADATA_LABELS = {"title": "书名称?", "author": "作者|著", "description": "简介|介紹"}

CONFLICT = {
    "underdog_revenge": ["底层", "逆袭", "翻身", "崛起", "草根", "平民", "寒门", "废物", "废柴", "被看不起", "被嘲笑", "被欺压", "讨回", "证明"],
    "revenge": ["复仇", "报仇", "血债", "灭门", "背叛", "陷害", "屈辱", "恨", "怨", "讨还", "清算", "以牙还牙"],
    "survival": ["生存", "活下去", "危机", "绝境", "生死", "危机", "逃命", "挣扎", "末日", "灾难", "危险"],
    "identity": ["身份", "我是谁", "归属", "认同", "找回", "迷失", "寻找", "真相", "身世", "秘密"],
    "love": ["爱", "喜欢", "心动", "表白", "在一起", "守护", "追求", "缘分", "命中注定", "相思"],
    "power_struggle": ["权力", "斗争", "争夺", "竞争", "上位", "掌控", "统治", "领导", "势力", "派系"],
    "moral_dilemma": ["选择", "牺牲", "取舍", "两难", "道德", "正义", "邪恶", "善恶", "良心", "底线"],
    "coming_of_age": ["成长", "成熟", "蜕变", "经历", "历练", "磨练", "懂事", "担当", "责任"],
}
HOOKS = {
    "face_slap": ["嘲讽", "轻视", "不屑", "冷笑", "打脸", "震惊", "目瞪口呆", "不可置信", "颜面扫地", "无地自容", "后悔", "求饶"],
    "comeback": ["绝境", "绝境反击", "翻盘", "逆转", "反杀", "逆袭", "起死回生", "绝处逢生", "力挽狂澜", "扭转乾坤"],
    "revelation": ["真相", "揭秘", "原来", "竟是", "没想到", "竟然", "身份曝光", "身世", "秘密揭开", "真相大白"],
    "romance": ["心动", "喜欢", "表白", "约会", "吃醋", "误会", "和好", "甜蜜", "浪漫", "告白", "在一起"],
    "climax": ["高潮", "决战", "最终战", "巅峰", "最强", "无敌", "碾压", "横扫", "一统", "登顶"],
    "suspense": ["悬念", "谜团", "未知", "即将", "将要", "危机", "阴谋", "陷阱", "幕后", "真相"],
    "tragedy": ["死", "牺牲", "离别", "永别", "泪", "痛", "伤", "虐", "心碎", "绝望", "无能为力"],
    "humor": ["笑", "哈哈", "搞笑", "逗", "吐槽", "幽默", "有趣", "好玩", "无厘头", "沙雕"],
}
VALUES = {
    "奋斗": ["努力", "奋斗", "拼搏", "坚持", "不放弃", "汗水", "付出", "收获"],
    "真诚": ["真诚", "真心", "诚实", "信任", "坦诚", "实在", "不虚伪"],
    "丛林法则": ["弱肉强食", "适者生存", "强者为尊", "实力至上", "拳头", "力量"],
    "因果报应": ["报应", "因果", "善恶有报", "天道", "轮回", "公道"],
    "自我实现": ["梦想", "追求", "理想", "目标", "实现", "价值", "意义"],
}
GOLDEN_FINGERS = {
    "system": ["系统", "叮", "面板", "任务", "奖励", "兑换", "积分", "等级提升", "系统提示", "系统商城"],
    "supernatural": ["异能", "超能力", "觉醒", "精神力", "念力", "元素", "火球", "冰箭", "雷电", "瞬移", "透视"],
    "space": ["空间", "小世界", "秘境", "洞天", "随身空间", "储物空间", "农场空间", "仙府", "洞府"],
    "knowledge": ["预知", "重生", "未来", "记忆", "知识", "信息差", "先知", "预测", "看穿", "洞察"],
    "connections": ["人脉", "关系", "背景", "靠山", "师父", "贵人", "家族", "势力", "组织", "门派"],
    "item": ["法宝", "神器", "宝物", "戒指", "项链", "玉佩", "古籍", "传承", "丹药", "符箓"],
    "rebirth": ["重生", "转世", "投胎", "回到", "再来一次", "前世", "上一世", "曾经"],
    "time_travel": ["穿越", "异界", "异世界", "古代", "星际", "平行世界", "时空", "另一个世界"],
}
CONSTRAINTS = {
    "代价": ["代价", "牺牲", "折寿", "消耗生命", "以命换", "付出"],
    "限制": ["限制", "冷却", "CD", "次数限制", "每日", "每月", "只能"],
    "副作用": ["副作用", "后遗症", "反噬", "失控", "暴走", "副作用"],
    "条件": ["条件", "必须", "才能", "只有", "要求", "前提"],
}
SEVERITY_GRAVEST, SEVERITY_GRAVE = ["死", "命", "生命", "灵魂"], ["严重", "巨大", "重大"]
POWER_SYSTEMS = {
    "修仙": ["炼气", "筑基", "金丹", "元婴", "化神", "合体", "大乘", "渡劫"],
    "武侠": ["后天", "先天", "宗师", "大宗师", "绝世", "内力", "真气"],
    "魔法": ["魔法", "法师", "魔导", "元素", "咒语", "魔力", "法杖"],
    "斗气": ["斗气", "斗者", "斗师", "大斗师", "斗灵", "斗王", "斗皇"],
    "武魂": ["武魂", "魂环", "魂兽", "魂力", "魂师", "大魂师", "魂尊"],
}
RESOURCES = ["资源", "分配", "垄断"]
GROWTH = {"static": ["无限", "无尽", "永恒", "固定", "不变"], "growth": ["升级", "提升", "进化", "成长", "进阶", "突破"], "exp": ["翻倍", "倍增", "指数", "爆炸", "暴涨"]}
PAINS = ["穷", "弱", "废物", "废柴", "被欺负", "被看不起", "没钱", "没背景", "没天赋", "困境", "绝境", "危机"]
PEAKS = ["巅峰", "最强", "无敌", "至高", "终极", "圆满"]
EXPLOITS = ["漏洞", "bug", "未被公开", "不知道", "秘密", "独占", "先机"]
ARCS = {
    "coward_to_brave": (["胆小", "懦弱", "害怕", "退缩"], ["勇敢", "坚强", "无畏", "挺身而出"]),
    "selfish_to_altruistic": (["自私", "自利", "只顾自己", "冷漠"], ["无私", "奉献", "为他人", "牺牲"]),
    "naive_to_scheming": (["天真", "单纯", "幼稚", "轻信"], ["腹黑", "深沉", "算计", "城府"]),
    "weak_to_strong": (["弱小", "无力", "被欺负", "废物"], ["强大", "无敌", "碾压", "顶尖"]),
    "lost_to_purposeful": (["迷茫", "困惑", "没有目标", "随波逐流"], ["坚定", "目标明确", "有追求", "方向清晰"]),
    "isolated_to_connected": (["孤独", "孤立", "没有朋友", "独行侠"], ["融入", "有伙伴", "团队", "归属"]),
}
TURNINGS = ["终于", "第一次", "意识到", "明白了", "决定", "改变", "从那以后", "转折点", "关键时刻", "顿悟", "觉醒"]
ROLES = {
    "tool_info": ["告诉", "消息", "情报", "信息", "听说", "据说", "透露", "知道", "了解", "清楚"],
    "tool_resource": ["给", "送", "提供", "资源", "钱", "丹药", "法宝", "帮助", "支持", "资助"],
    "tool_escape": ["救", "掩护", "撤退", "后路", "退路", "接应", "支援", "脱险", "逃生"],
    "emotion_trigger": ["激怒", "刺激", "感动", "心疼", "愤怒", "悲伤", "开心", "激动", "兴奋"],
    "emotion_sacrifice": ["死", "牺牲", "保护", "挡", "为了", "付出", "代价", "生命", "舍命"],
    "contrast_foil": ["傲慢", "嚣张", "愚蠢", "聪明", "善良", "邪恶", "相反", "对比", "衬托"],
    "conflict_antagonist": ["敌人", "对手", "仇", "恨", "针对", "陷害", "阻挠", "破坏", "对抗"],
}
PERSON_PATTERNS = [r"(\w{2,4})(?:师兄|师弟|师姐|师妹|师父|徒弟|长老|掌门|家主|少爷|小姐)", r"(\w{2,4})(?:哥|姐|弟|妹|叔|姨|伯|爷)"]
SPEECH_PATTERN = r"""['"][^'"]*?(?:啧|哼|啊|呢|吧|吗)[^'"]*?['"]"""
BEHAVIOURS = {"摸鼻子": "摸.{0,2}鼻子", "皱眉": "皱.{0,2}眉", "冷笑": "冷.{0,2}笑", "挑眉": "挑.{0,2}眉"}
HABITS = ["喝茶", "喝酒", "抽烟", "看书", "练剑", "打坐"]
RELATIONSHIPS = {"同门": ["师兄", "师姐", "师弟", "师妹"], "师徒": ["师父", "师傅"], "亲属": ["哥", "姐", "弟", "妹"]}
INFO_TYPES = {
    "世界观": ["世界", "大陆", "帝国", "宗门", "势力", "规则", "法则"],
    "人物背景": ["身世", "来历", "过去", "经历", "背景", "家族", "身份"],
    "剧情伏笔": ["秘密", "真相", "阴谋", "计划", "目的", "幕后"],
}
RELEASE_METHODS = {"主动告知": ["告诉", "说", "解释", "介绍"], "侧面暗示": ["暗示", "透露", "隐约", "似乎"]}
RELEASE_OTHER = "探索发现"
FIRST_PERSON, THIRD_PERSON = "我|俺|咱|本人", "他|她|它|主角|男主|女主"
SWITCH_PATTERN = "我.*?(?:他|她)|(?:他|她).*?我"
SENSES = {
    "视觉": ["看", "见", "望", "视", "颜色", "光", "影", "形", "貌"],
    "听觉": ["听", "闻", "声", "音", "响", "叫", "喊", "说"],
    "触觉": ["摸", "触", "感", "温度", "冷", "热", "痛", "软", "硬"],
    "嗅觉": ["闻", "香", "臭", "味", "气", "嗅"],
    "味觉": ["吃", "尝", "甜", "苦", "辣", "酸", "咸", "鲜"],
}
AUDIENCES = {
    "student_middle": ["高中", "初中", "中考", "高考", "班级", "同学", "老师", "校园", "青春期", "叛逆", "成长"],
    "student_college": ["大学", "宿舍", "室友", "社团", "选课", "考试", "毕业", "就业", "实习", "考研"],
    "workplace_junior": ["职场", "新人", "实习", "面试", "入职", "老板", "同事", "加班", "升职加薪", "996"],
    "workplace_senior": ["管理", "项目", "团队", "总监", "经理", "创业", "融资", "上市", "并购", "战略"],
    "middle_aged": ["中年", "家庭", "孩子", "教育", "房贷", "压力", "危机", "转型", "第二春", "回忆"],
}
PAYMENT_TRIGGERS = {
    "悬念": ["悬念", "谜团", "未知", "即将", "接下来", "下一章"],
    "爽点": ["打脸", "逆袭", "翻盘", "震惊", "无敌", "碾压"],
    "情感": ["感动", "心疼", "泪目", "虐", "甜", "暖"],
    "认同": ["共鸣", "真实", "像自己", "代入感", "感同身受"],
}
ADAPTATIONS = {
    "short_drama": ["冲突", "反转", "快节奏", "爽点密集", "场景简单", "人物少"],
    "anime": ["世界观", "战斗", "特效", "视觉", "热血", "冒险"],
    "audiobook": ["对话", "心理描写", "情感", "氛围", "节奏适中"],
    "game": ["系统", "升级", "装备", "技能", "副本", "任务", "战斗"],
    "film": ["剧情", "深度", "主题", "视觉", "情感", "冲突"],
    "comic": ["画面感", "动作", "表情", "分镜", "视觉冲击力"],
}
GENDERS = {"male": ["热血", "战斗", "升级", "争霸", "兄弟", "妹子"], "female": ["爱情", "甜宠", "虐恋", "宫斗", "闺蜜", "男神"]}
SPEAKER_PATTERN, SCENE_PATTERN = "[一-龥]{2,4}(?:说道|说)", "场景|地点|地方"

# Constants by category.
AGE_RANGES = {"student_middle": (12, 18), "student_college": (18, 25), "workplace_junior": (22, 30), "workplace_senior": (30, 45), "middle_aged": (35, 55)}
MOTIVATIONS = {"悬念": "追更解谜", "爽点": "获得爽感", "情感": "情感满足", "认同": "自我代入"}
BASE_ARPU = {"student_middle": 15.0, "student_college": 25.0, "workplace_junior": 50.0, "workplace_senior": 80.0, "middle_aged": 60.0}
MOTIVATION_FACTOR = {"追更解谜": 1.2, "获得爽感": 1.0, "情感满足": 1.3, "自我代入": 1.1}
BASE_COST = {"short_drama": 0.8, "audiobook": 0.9, "comic": 0.6, "anime": 0.3, "film": 0.2, "game": 0.25}
HOOK_RESPONSES = {
    "face_slap": "爽快感、满足感", "comeback": "激动、振奋", "revelation": "惊讶、恍然大悟", "romance": "心动、甜蜜",
    "climax": "兴奋、满足", "suspense": "紧张、好奇", "tragedy": "悲伤、共鸣", "humor": "轻松、愉悦",
}
FORMULAS = {
    "underdog_revenge": ("底层逆袭公式", "摆脱底层身份，获得尊重和地位", "资源匮乏、权力压制、阶层固化", "金手指/认知差/贵人相助", ["都市", "修仙", "玄幻"]),
    "revenge": ("复仇公式", "讨还不公，让仇人付出代价", "仇人实力强大、信息不对等", "隐忍积累、借力打力、以弱胜强", ["武侠", "都市", "历史"]),
    "survival": ("生存公式", "在极端环境中活下去", "资源匮乏、环境恶劣、敌人环伺", "智慧、勇气、结盟、进化", ["末日", "荒野", "无限流"]),
    "coming_of_age": ("成长公式", "从幼稚到成熟，找到人生方向", "认知局限、外界诱惑、内心迷茫", "经历挫折、获得 mentorship、自我反思", ["青春", "职场", "修仙"]),
}
FORMULA_DEFAULT = ("通用冲突公式", "实现核心目标", "面临主要阻碍", "采取解决行动", ["通用"])
INITIAL_POWERS = {
    "system": "基础功能开启，可接取初级任务", "supernatural": "初级异能觉醒，能力微弱", "space": "小型空间开启，可存储少量物品",
    "knowledge": "获得部分未来信息或知识", "item": "获得初级法宝或道具", "rebirth": "保留前世记忆",
    "time_travel": "穿越到异世界/过去", "connections": "获得某位贵人关注",
}
PLOT_IMPACTS = {
    "代价": "增加主角决策的沉重感，提升剧情张力", "限制": "创造剧情瓶颈，推动主角寻找突破方法",
    "副作用": "增加不确定性，制造危机时刻", "条件": "设置剧情触发门槛，控制节奏",
}
ARC_STARTS = {
    "coward_to_brave": "胆小懦弱，遇事退缩", "selfish_to_altruistic": "自私冷漠，只顾自己", "naive_to_scheming": "天真单纯，容易轻信",
    "weak_to_strong": "实力弱小，常被欺负", "lost_to_purposeful": "迷茫困惑，没有方向", "isolated_to_connected": "孤独孤立，没有归属",
}
ARC_ENDS = {
    "coward_to_brave": "勇敢坚强，挺身而出", "selfish_to_altruistic": "无私奉献，心系他人", "naive_to_scheming": "深沉腹黑，善于算计",
    "weak_to_strong": "实力强大，无人敢欺", "lost_to_purposeful": "目标明确，坚定不移", "isolated_to_connected": "融入集体，有归属感",
}
POPULAR_ARCS = ["weak_to_strong", "coward_to_brave", "naive_to_scheming"]
COMMON_PAIRS = [("system", "dynamic_linear"), ("rebirth", "static"), ("supernatural", "dynamic_linear")]
REUSABLE_ROLES = ["tool_info", "conflict_antagonist", "emotion_trigger"]
ROLE_TEXTS = {
    "tool_info": "信息提供者，为主角提供关键情报", "tool_resource": "资源提供者，给予主角物资支持", "tool_escape": "退路提供者，在危机时刻救助主角",
    "emotion_trigger": "情绪触发器，激发主角情感反应", "emotion_sacrifice": "牺牲型配角，为剧情提供虐点", "contrast_foil": "对比衬托型，突出主角特质",
    "conflict_antagonist": "冲突制造者，推动剧情发展",
}
PLOT_FUNCTIONS = {
    "tool_info": "推动信息线，提供剧情线索", "tool_resource": "解决资源困境，助力主角成长", "tool_escape": "制造安全网，增加剧情容错",
    "emotion_trigger": "激发情感波动，增强代入感", "emotion_sacrifice": "制造情感高潮，深化主题", "contrast_foil": "强化主角形象，突出特质",
    "conflict_antagonist": "制造冲突，推动情节",
}
GF_NAMES = {"system": r"(?U)(\w+系统)", "space": r"(?U)(\w+空间)", "item": r"(?U)(\w+戒指|\w+项链|\w+玉佩)"}

# Rules: id, label, target field, kind, keywords or pattern, weight. The label is the value that a rule stands for.
RULES = [
    ("rule_task_system", "系统流", "task.task_structure", "keyword", ["系统面板", "系统提示", "叮！", "任务完成", "奖励发放"], 0.9),
    ("rule_task_signin", "签到流", "task.task_structure", "keyword", ["签到", "打卡", "连续签到", "签到奖励"], 0.8),
    ("rule_task_levelup", "升级流", "task.task_structure", "keyword", ["突破", "升级", "境界提升", "等级提升", "经验值"], 0.7),
    ("rule_bg_xianxia", "仙侠", "background.world_type", "keyword", ["修真", "修仙", "灵根", "筑基", "金丹", "元婴", "渡劫", "飞升", "宗门", "法宝"], 0.9),
    ("rule_bg_fantasy", "玄幻", "background.world_type", "keyword", ["斗气", "魔法", "武魂", "魂环", "魂兽", "异火", "秘境", "遗迹"], 0.9),
    ("rule_bg_urban", "都市", "background.world_type", "keyword", ["都市", "现代", "公司", "学校", "医院", "警察", "总裁", "校花"], 0.8),
    ("rule_bg_history", "历史", "background.world_type", "keyword", ["大明", "大唐", "大宋", "清朝", "秦朝", "汉朝", "皇帝", "宰相", "科举"], 0.8),
    ("rule_bg_scifi", "科幻", "background.world_type", "keyword", ["星际", "宇宙", "飞船", "机甲", "基因", "虫族", "未来", "AI", "人工智能"], 0.9),
    ("rule_power_cultivation", "修仙境界", "background.power_system", "keyword", ["炼气", "筑基", "金丹", "元婴", "化神", "合体", "大乘", "渡劫"], 0.95),
    ("rule_power_martial", "武侠境界", "background.power_system", "keyword", ["后天", "先天", "宗师", "大宗师", "绝世", "内力", "真气", "经脉"], 0.9),
    ("rule_power_magic", "魔法体系", "background.power_system", "keyword", ["魔法", "法师", "魔导", "元素", "火球术", "冰箭", "咒语"], 0.85),
    ("rule_write_firstperson", "first_person", "writing.narrative_perspective", "regex", r"^(我|俺|咱)[\s\p{P}]", 0.8),
    ("rule_write_thirdperson", "third_person", "writing.narrative_perspective", "regex", r"^(他|她|它|主角|男主|女主)[\s\p{P}]", 0.7),
    ("rule_write_fast", "快节奏", "writing.pacing", "keyword", ["瞬间", "立刻", "马上", "直接", "毫不犹豫"], 0.6),
    ("rule_write_humor", "幽默", "writing.humor_style", "keyword", ["吐槽", "搞笑", "逗比", "沙雕", "无厘头", "哈哈哈"], 0.7),
    ("rule_plot_revenge", "复仇", "plot.conflict_types", "keyword", ["复仇", "报仇", "血债", "灭门", "背叛", "陷害", "屈辱"], 0.8),
    ("rule_plot_romance", "恋爱", "plot.conflict_types", "keyword", ["喜欢", "爱", "心动", "表白", "约会", "吃醋", "分手", "复合"], 0.7),
    ("rule_plot_competition", "竞争", "plot.conflict_types", "keyword", ["比赛", "竞争", "对决", "挑战", "排名", "冠军", "第一"], 0.7),
]
