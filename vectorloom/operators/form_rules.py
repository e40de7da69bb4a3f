"""Fixed values of the form-to-Markdown rules: word lists, templates, markers.

They are data, not logic: results depend on their exact text and order.
"""

# Business domains and their keywords; the first domain with a hit wins.
DOMAINS = {
    "财务": ["财务", "会计", "账簿", "凭证", "科目", "核算", "成本", "预算", "资金", "现金", "银行", "报销", "费用", "发票", "税务", "税", "利润", "资产", "负债", "收入", "支出"],
    "供应链": ["采购", "供应商", "物料", "库存", "仓库", "入库", "出库", "发货", "收货", "订单", "合同", "招标", "投标", "寻源"],
    "生产": ["生产", "车间", "工序", "工艺", "质检", "检验", "维修", "设备", "保养", "计划", "排程", "工单"],
    "销售": ["销售", "客户", "订单", "渠道", "价格", "促销", "营销", "零售", "门店", "会员"],
    "人力": ["员工", "人员", "入职", "离职", "考勤", "薪资", "工资", "绩效", "培训", "招聘", "档案", "职位", "部门"],
    "项目": ["项目", "任务", "计划", "进度", "里程碑", "甘特图", "资源", "工时"],
    "资产": ["资产", "设备", "固定资产", "折旧", "盘点", "领用", "归还", "报废"],
    "审批": ["审批", "审核", "流程", "节点", "待办", "已办", "驳回", "通过"],
    "基础": ["组织", "用户", "角色", "权限", "参数", "配置", "模板", "档案", "分类"],
    "集成": ["接口", "API", "连接", "同步", "导入", "导出", "映射", "转换"],
    "监控": ["监控", "日志", "预警", "异常", "任务", "调度", "执行", "进度"],
    "报表": ["报表", "报告", "查询", "统计", "分析", "图表", "打印", "导出"],
    "单据": ["单据", "票据", "发票", "收据", "凭证", "编号", "状态"],
    "合同": ["合同", "协议", "条款", "签订", "变更", "终止", "续签"],
    "质量": ["质量", "检验", "检测", "标准", "合格", "不合格", "整改"],
    "服务": ["服务", "请求", "工单", "响应", "处理", "反馈", "评价"],
}
DEFAULT_DOMAIN = "业务"

# Description templates by form type; the first type named in the form name wins.
DESCRIPTIONS = {
    "报告": "{name}用于生成和管理{domain}相关报告，支持报告创建、查询和导出功能。",
    "查询": "{name}用于{domain}数据的查询和检索，支持多条件筛选和数据导出。",
    "设置": "{name}用于配置{domain}相关参数和规则，支持参数维护和生效控制。",
    "列表": "{name}用于展示和管理{domain}列表数据，支持列表查询、筛选和操作。",
    "详情": "{name}用于展示{domain}详细信息，支持信息查看和维护。",
    "编辑": "{name}用于{domain}信息的编辑和维护，支持数据新增、修改和删除。",
    "选择": "{name}用于{domain}数据的选择和引用，支持快速检索和关联。",
    "申请": "{name}用于{domain}相关申请流程，支持申请提交、审批和跟踪。",
    "审批": "{name}用于{domain}审批流程管理，支持审批发起、流转和记录。",
    "台账": "{name}用于记录和管理{domain}台账数据，支持台账登记、查询和统计。",
    "单据": "{name}用于{domain}单据处理，支持单据创建、审核和归档。",
    "模板": "{name}用于{domain}模板管理，支持模板创建、复制和应用。",
    "配置": "{name}用于{domain}配置管理，支持配置项设置和生效。",
    "记录": "{name}用于记录{domain}操作日志，支持日志查询和追溯。",
    "任务": "{name}用于{domain}任务管理，支持任务创建、分配和跟踪。",
    "默认": "{name}用于{domain}业务处理，支持数据管理和流程控制。",
}
DEFAULT_TYPE = "默认"

# Audit fields never named as key fields, and the sentence naming key fields.
AUDIT_FIELDS = ["创建人", "修改人", "创建时间", "修改时间", "审核人", "审核日期"]
KEY_FIELDS_BEFORE, KEY_FIELDS_AFTER = "主要包含", "等关键字段。"
KEY_FIELDS_SEEN, KEY_FIELDS_NAMED = 5, 3

# Scenario rules in order. Each is (words in the text, word in a lower-cased field
# name, exact field names, scenario).
SCENARIOS = [
    (["创建", "新增"], "billno", [], "创建新的{name}记录"),
    (["查询", "列表", "检索"], None, [], "查询和检索{name}数据"),
    (["审批", "审核"], "billstatus", [], "提交{name}进行审批流程"),
    (["修改", "编辑"], None, [], "修改和更新{name}信息"),
    (["导出", "打印"], None, [], "导出或打印{name}报表"),
    ([], None, ["状态"], "跟踪{name}状态变更"),
    ([], None, ["组织"], "按组织维度管理{name}"),
    ([], None, ["金额", "费用"], "统计和分析{name}金额数据"),
    ([], None, ["日期", "时间"], "按时间范围筛选{name}"),
]
FALLBACK_SCENARIOS = ["创建和管理{name}记录", "查询{name}详细信息", "维护{name}基础数据"]
MAX_SCENARIOS = 5

# Headings, markers and defaults of the documents.
DESCRIPTION_HEADING = "## 功能描述"
SCENARIO_HEADING = "## 业务场景"
FIELDS_HEADING = "## 字段信息"
DESCRIPTION_MARKER = "<!-- AI_GENERATED_DESCRIPTION -->"
DESCRIPTION_TODO = "<!-- 待 AI 自动生成功能描述 -->"
SCENARIO_MARKER = "<!-- AI_GENERATED_SCENARIOS -->"
SCENARIO_TODO = "<!-- 待 AI 自动生成业务场景 -->"
NO_FIELDS = "<!-- 无字段信息 -->"
ID_LABEL = "**表单标识**"
CREATED_LABEL = "- **创建时间**: "
ORIGIN_LINE = "- **数据来源**: Oracle 数据库导出"
UNKNOWN_ID = "unknown"
UNNAMED_FORM = "未命名表单"
UNNAMED_FILE = "未命名"

# Patterns of the title line and of the field table.
TITLE_PATTERN = r"(?d)^# (.+?) (.+?) 数据结构文档"
# The table ends before a line that starts with --- or ##; lines are taken whole, without a look ahead at each character.
TABLE_PATTERN = r"(?d)\| 层级 \|[^\n]*\n((?:[^\n]++|\n(?!---|##))*+)"
TABLE_HEADER = "| 层级"
NAME_HEADER = "字段名称"
