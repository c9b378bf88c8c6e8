"""Language and domain profiles: every list, pattern, rule and cap of the engine is data here."""

from __future__ import annotations

from dataclasses import dataclass, field

TypeRules = tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Profile:
    """What the operators need to know of a language and a domain.

    ``type_rules`` and ``fine_type_rules`` are tried in order, the first type with a keyword in the
    term holds; ``triggers`` are tried in order too. In ``constraints`` None allows any type.
    """

    name: str
    sentence_marks: str
    stopwords: frozenset[str] = frozenset()
    latin_stopwords: frozenset[str] = frozenset()
    latin_whitelist: frozenset[str] = frozenset()
    latin_keep: frozenset[str] = frozenset()
    noise_parts: tuple[str, ...] = ()
    noise_terms: frozenset[str] = frozenset()
    noise_latin_parts: tuple[str, ...] = ()
    type_rules: TypeRules = ()
    fine_type_rules: TypeRules = ()
    topic_rules: TypeRules = ()
    default_type: str = "Concept"
    default_topic: str = "综合"
    final_noise: frozenset[str] = frozenset()
    final_latin_keep: frozenset[str] = frozenset()
    pragmatic: tuple[str, ...] = ()
    trigger_words: frozenset[str] = frozenset()
    entity_patterns: tuple[tuple[str, str], ...] = ()
    relations: tuple[tuple[str, tuple[str, ...]], ...] = ()
    constraints: dict = field(default_factory=dict)
    max_distance: int = 80
    min_sentence: int = 8
    min_freq: int = 2
    max_ngram: int = 4
    max_term: int = 24
    max_token: int = 20
    max_pmi: int = 8000
    max_terms: int = 3000

    @property
    def triggers(self) -> tuple[tuple[str, str], ...]:
        """(trigger, relation) in order of priority: a trigger listed twice keeps its first place and takes
        its last relation."""
        out: dict[str, str] = {}
        for relation, words in self.relations:
            for w in words:
                out[w] = relation
        return tuple(out.items())


def _words(s: str) -> tuple[str, ...]:
    return tuple(s.split())


def _rules(s: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((line.split(":")[0].strip(), _words(line.split(":")[1])) for line in s.strip().splitlines())


# Word lists, rules and patterns of the zh profile, in their order.
_STOP = """研究 分析 设计 方法 技术 系统 模型 问题 结果 实验 结构 控制 性能 进行 提出 一种 本文 可以 具有 以及 采用 目录 摘要 关键词 作者 出版社
文献 引言 收稿日期 录用日期 其中 因此 所示 图 表 式中 例如 此外 近年来 在文献 在此基础上 同时 项目 切块 北京 王道 目前 由于 为此 平均时间 王育"""
_LATIN_STOP = """a an analysis and application as at based by cn control controlfor controlof decision deformation design development dynamic
dynamics edu et etal feedback flight flexible for from gain http https in into integral is journal journalof learning method mission mode model
modeling multibody neural nonlin nonlinear of on optimization or partial performance policy press quad research review right science simulation
sliding state study sweep switched switching system systems technology the time to uncertain variable vehicle with www begin end dot dfrac sqrt
frac cdot bmatrix qquad
aiaa aerospace buaa chinese hkxb ieee piscataway wang aviation editorial
sin cos tan alpha beta gamma delta theta omega rho mu psi phi varphi sigma lambda dt lpv pid phing trol"""
_NOISE_PARTS = "学报 编辑部 大学 学院 研究所 出版社 期刊 报社 由式 将式 代入式 根据式 则式 把式 见图 如图 参考文献 绪论"
_NOISE_TERMS = """可得 可见 所以 但是 这样 此时 显然 得到 方程 代入 计算 基于 然而 注意 如果 由此可见 可以看出 一般来说 另一方面 另外 时间 火箭 美国
左右 导弹 温度 英尺"""
_NOISE_LATIN = "journalof ofmorphing inchinese controlof controlfor editor journal press http https www edu cn"
_TYPES = """ControlMethod: 控制 预测控制 自适应 鲁棒 滑模 规划 决策 算法 MPC 反步法
Mechanism: 机制 驱动 变形 展开 折叠 切换 重构 morphing 变换策略
Structure: 机翼 翼型 翼面 机身 尾翼 结构 铰接 舵面 wing
Performance: 升阻比 稳定性 机动性 效率 气动 航程 载荷 性能 高度
Mission: 任务 巡航 起飞 着陆 机动 跨域 飞行
Parameter: 攻角 速度 马赫数 参数 角度 载荷因子 雷诺数 高度
Aircraft: 飞行器 航天器 飞机 无人机 变体 空天 aircraft uav"""
_FINE_TYPES = """ControlMethod: 控制律 控制方法 控制策略 控制算法 预测控制 自适应控制 滑模控制 反步法 遗传算法 强化学习 深度学习 神经网络 MPC PID LQR DDPG 规划 决策 优化算法 气动实验与测量控制 采样 策略 控制 偏航
Mechanism: 变形 折叠 展开 切换 变构 morphing 驱动机制 铰接机构 后缘增升 三缝 双折叠 变后掠 折展 分离 机翼变体 机构驱动 展收 弯曲 变换
Structure: 机翼 翼型 翼面 机身 尾翼 舵面 蒙皮 隔框 翼梁 铰链 前缘 后缘 翼根 翼尖 垂尾 平尾 翼展 夹层 复合材料结构 结构设计 活动机翼 固定机翼 wing fuselage flap 装配 螺栓 螺钉 密封圈 铝合金 环氧树脂 胶接 转轴 铰接 侧缘 上机翼
Performance: 升阻比 稳定性 机动性 气动特性 气动性能 鲁棒性 可靠性 控制品质 升力系数 阻力系数 俯仰力矩 诱导阻力 响应速度 振动 弯矩 推力 航程 气动热 动稳定性 最优解 成本低 压力系数 局部应力 安全系数 载荷 设计载荷 诱导阻力系数 翼载荷 上下机翼处于不同位置时双翼
Mission: 巡航 起飞 着陆 机动 跨域飞行 再入 轨道 返回舱 飞行试验 低速 超声速 高速 阵风 临近空间 飞行时间 主要任务 飞行阶段 超临界
Parameter: 攻角 迎角 速度 高度 马赫数 参数 角度 载荷因子 雷诺数 展弦比 弦长 展长 厚度 弯度 俯仰角 偏航角 上反角 四元数 初始应变 约束条件 设计变量 声速 倍弦长 热导率 相对厚度 相对面积 热膨胀 热导 温度梯度 地面坐标系 迎风 坐标 参考面积 机翼面积
Aircraft: 飞行器 航天器 飞机 无人机 变体 空天 变构 aircraft uav drone 飞船 返回舱 空天飞行器 喷气运输机 跨域 双折叠翼变体
Document: 文献 论文 项目 综述 期刊 学报"""
_TOPICS = """变构飞行器: 变构 变体 跨域
飞行控制: 控制 姿态 预测控制 自学习
气动设计: 气动 翼型 升阻比
结构设计: 结构 机翼 机身
飞行动力学: 动力学 轨道 航天"""
_FINAL_NOISE = """和式 则有 于是 最后 可知 全球鹰 重力 运动学方程 翼根效应 亚声速 迎风面 应用变体技术减少了50 首先 其次 然后 最后 总之 综上所述 因此 所以
但是 然而 因为 由此 从而 那么 同样 一般情况下 当然 第一 第二 第三 也就是说 实际上 简称 由图 由表 对于单 以上 续表 的关系 的变化 在式 对于 有关 因而 这时
由此可见 概述 苏联 西安 米格 幻影 阿波罗 增大 减小 变大 变小 增加 减少 矢量 位置 材料 试验 概率 强度"""
_PRAGMATIC = (
    "^(如果|虽然|尽管|对于|由于|关于|通过|为了|当|若|则|使得|根据|根)",
    "^(升力|阻力|力矩|面积|位置|强度|材料|试验|载荷|压力|应力|质量|速度|时间)$",
    "(续表|第[0-9]+章|图[0-9]|表[0-9]|式[0-9]|附录)",
    "^[的地得]",
    "锥如|到织|对于单|的变化|的关系|的形式",
)
_TRIGGER_WORDS = """包括 包含 组成 由 采用 使用 基于 影响 决定 改变 适用于 用于 面向 支持 服务于 具有 具备 参数为 取值 设定为 见 记载于 发表于 是一种
属于 可视为"""
_RELATIONS = """is_a: 是一种 属于 可视为 是一类 即
has_component: 包括 包含 由 组成 具有以下 主要有
uses_method: 采用 使用 基于 利用
affects: 影响 决定 改变 作用于 制约
applies_to: 适用于 用于 面向 针对
supports_mission: 支持 服务于 满足
has_mechanism: 具有 具备 通过
has_parameter: 参数为 取值 设定为 表示为
documented_in: 见 记载于 发表于 出自
part_of: 是 组成部分 属于"""
_CONSTRAINTS = {
    "is_a": (None, None),
    "has_component": ("Aircraft Structure Mechanism ControlMethod", "Aircraft Structure Mechanism ControlMethod Performance Parameter"),
    "uses_method": ("Aircraft Mission Structure", "ControlMethod Mechanism"),
    "affects": ("Parameter Structure Mechanism ControlMethod", "Performance Parameter Mission"),
    "applies_to": ("ControlMethod Mechanism", "Aircraft Mission"),
    "supports_mission": ("Aircraft Structure ControlMethod Mechanism Performance", "Mission"),
    "has_mechanism": ("Aircraft Structure", "Mechanism"),
    "has_parameter": ("Aircraft Structure Mechanism ControlMethod", "Parameter"),
    "documented_in": (None, "Document"),
    "part_of": (None, "Aircraft Structure Mechanism"),
}
# End of fixed values.

ZH = Profile(
    name="zh",
    sentence_marks="。！？!?；;",
    stopwords=frozenset(_words(_STOP)),
    latin_stopwords=frozenset(_words(_LATIN_STOP)),
    latin_whitelist=frozenset(_words("aircraft morphing uav wing mpc")),
    latin_keep=frozenset(_words("mpc uav")),
    noise_parts=_words(_NOISE_PARTS),
    noise_terms=frozenset(_words(_NOISE_TERMS)),
    noise_latin_parts=_words(_NOISE_LATIN),
    type_rules=_rules(_TYPES),
    fine_type_rules=_rules(_FINE_TYPES),
    topic_rules=_rules(_TOPICS),
    final_noise=frozenset(_words(_FINAL_NOISE)),
    final_latin_keep=frozenset(_words("morphing aircraft wing uav mpc lqr pid")),
    pragmatic=_PRAGMATIC,
    trigger_words=frozenset(_words(_TRIGGER_WORDS)),
    entity_patterns=(
        ("[0-9]+(?:[.][0-9]+)?(?:°|度|m/s|km/h|马赫|N|Pa)", "Parameter"),
        ("[A-Za-z]+控制", "ControlMethod"),
        ("(?:机翼|翼型|尾翼|机身|舵面|铰接机构)", "Structure"),
    ),
    relations=_rules(_RELATIONS),
    constraints={k: tuple(None if x is None else frozenset(_words(x)) for x in v) for k, v in _CONSTRAINTS.items()},
)

# For corpora in Latin script; triggers are padded with spaces for want of word boundaries.
LATIN = Profile(
    name="latin",
    sentence_marks=".!?;",
    latin_stopwords=frozenset(_words("the of and to a in is it for was on be by as are at that with this from or an")),
    type_rules=_rules("Mechanism: tion\nControlMethod: ing\nStructure: er\nParameter: th\nAircraft: an"),
    entity_patterns=(("[0-9]+(?:[.,][0-9]+)*", "Parameter"),),
    relations=(("is_a", (" is ",)), ("part_of", (" of ",)), ("has_component", (" with ",)), ("uses_method", (" by ",)),
               ("applies_to", (" for ",)), ("affects", (" that ",))),
    constraints=ZH.constraints,
)
