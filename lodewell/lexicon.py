"""Fixed values of the domain: word lists, synonyms and lookups that results depend on.

Keys are looked up in lower-cased text, so keys with upper-case letters are met by no token; they stay for
those who read the tables.
"""

#: English words for Chinese ones.
CHINESE_TO_ENGLISH = {
    "时间": ["time", "Time", "TIME"],
    "同步": ["sync", "Sync", "SYNC", "synchronize"],
    "获取": ["get", "fetch", "obtain", "acquire"],
    "设备": ["device", "Device", "DEVICE"],
    "信息": ["info", "information", "Information"],
    "配对": ["pair", "Pair", "PAIR", "pairing"],
    "绑定": ["bind", "Bind", "BIND", "bond", "Bond", "BOND"],
    "解绑": ["unbind", "Unbind", "UNBIND"],
    "骑行": ["ride", "Ride", "RIDE", "riding"],
    "记录": ["record", "Record", "RECORD", "log"],
    "故障": ["fault", "Fault", "FAULT", "error", "Error", "ERROR"],
    "电量": ["battery", "Battery", "BATTERY", "power"],
    "电池": ["battery", "Battery", "BATTERY"],
    "升级": ["upgrade", "Upgrade", "UPGRADE", "ota", "OTA", "update"],
    "BLE": ["ble", "Ble", "BLUETOOTH", "bluetooth"],
    "上报": ["report", "Report", "REPORT", "report"],
    "数据": ["data", "Data", "DATA", "dp", "DP"],
    "DP": ["dp", "DP", "data", "Data", "DATA"],
    "dp": ["dp", "DP", "data", "Data", "DATA"],
}

#: Synonyms.
SYNONYMS = {
    "同步": ["dp_query", "0x0003", "APP_SYNC_TIME", "状态查询", "上报", "0x8003", "时间同步"],
    "获取": ["同步", "查询", "获取时间", "获取同步"],
    "获取时间": ["时间同步", "同步", "APP_SYNC_TIME", "0x8003"],
    "时间信息": ["时间同步", "时间", "APP_SYNC_TIME", "0x8003", "0x0025"],
    "骑行": ["record", "0x8005", "record_reported", "骑行记录"],
    "生成": ["创建", "产生"],
    "数据": ["dp", "DP", "data"],
    "App": ["app", "应用程序"],
    "开机": ["启动", "开机电"],
    "指令": ["命令", "can指令"],
    "仪表": ["车仪表", "车载仪表"],
    "CAN": ["can", "CAN", "总线"],
    "状态查询": ["dp_query", "0x0003", "查询"],
    "BLE": ["ble", "蓝牙"],
    "上报": ["report", "REPORT"],
    "报文": ["message", "MSG", "can报文"],
    "bluetooth": ["bluetooth", "BLE", "ble"],
    "record": ["record", "骑行", "骑行记录"],
    "0x8005": ["0x8005", "record_reported", "RECORD_REPORTED", "骑行记录", "RECORD_REPORT", "记录帧"],
    "骑行记录": ["record", "0x8005", "record_reported", "骑行", "生成记录", "记录上报"],
    "dp_query": ["dp_query", "DP_QUERY", "状态查询", "0x0003"],
    "报错": ["fault", "error", "alarm", "detection", "故障", "异常", "错误"],
    "故障": ["fault", "alarm", "rollover", "detection", "FAULT", "ALARM", "报错", "异常"],
    "错误": ["error", "fault", "err", "ERROR", "异常"],
    "riding": ["骑行", "record", "骑行记录"],
    "battery": ["电量", "电池", "battery_percentage"],
    "fault": ["故障", "alarm", "错误"],
    "OTA": ["升级", "ota"],
    "时间": ["time", "时间同步", "APP_SYNC_TIME", "0x8003", "0x0025"],
    "0x8003": ["0x8003", "APP_SYNC_TIME", "时间同步", "SYNC_TIME", "时间帧", "同步时间"],
    "配对": ["pair", "pairing", "bond", "绑定"],
    "绑定": ["bond", "bonding", "bind", "配对"],
    "解绑": ["unbind", "解绑请求", "DEVICE_UNBIND"],
    "帧格式": ["frame", "帧格式", "帧结构", "CMD", "0x8003", "0x8005"],
    "HID": ["hid", "HID", "人机接口"],
    "BMS": ["bms", "BMS", "电池管理"],
    "电量": ["battery", "电池", "电量百分比", "battery_percentage"],
    "充电": ["charge", "充电", "充电器"],
    "故障检测": ["fault", "alarm", "检测", "rollover", "碰撞", "震动"],
    "rollover": ["翻车", "rollover", "倾倒"],
    "震动": ["vibration", "震动", "震动报警"],
    "碰撞": ["collision", "碰撞", "collide"],
}

#: Technical terms.
TECH_TERMS = {
    "骑行": ["record", "0x8005", "record_reported", "vl_ble"],
    "同步": ["dp_query", "0x0003", "APP_SYNC_TIME", "BLE", "sync", "0x8003", "时间同步"],
    "App": ["app", "ble", "vl_app"],
    "开机": ["power", "boot", "start", "iot"],
    "CAN": ["CAN", "can", "vl_can"],
    "指令": ["cmd", "command", "frame", "ota"],
    "骑行记录": ["record", "0x8005", "record_reported", "vl_ble_record"],
    "同步数据": ["dp", "data", "sync", "dp_query"],
    "状态查询": ["dp_query", "0x0003", "query", "status"],
    "报错机制": ["fault", "alarm", "detection", "fault_param", "rollover_detect"],
    "故障检测": ["fault", "alarm", "FAULT_TYPE", "DPID_FAULT_DETECTION", "rollover"],
    "错误处理": ["error", "fault", "err", "mbedtls_err", "ERROR_CODE"],
    "riding": ["骑行", "record", "0x8005", "骑行记录"],
    "fault": ["故障", "alarm", "rollover", "FAULT_TYPE"],
    "OTA": ["升级", "ota", "OTA_START", "固件", "ota_upgrade"],
    "battery": ["电量", "电池", "BMS", "battery_percentage"],
    "时间同步": ["time_sync", "APP_SYNC_TIME", "0x8003", "0x0025"],
    "配对绑定": ["pair", "bond", "bind", "HID_pair", "BLE_pair"],
    "帧格式": ["frame_format", "帧格式", "帧结构", "CMD:"],
}

#: Words that stand for each other in queries about data points, and what is put behind such queries.
DP_TOKENS = ("dp", "data", "report", "query")
DP_VARIANTS = ("dp", "DP", "data", "Data", "DATA", "report", "Report", "REPORT")
DP_MARKS = ("dp", "数据", "上报")
DP_SUFFIXES = ("0x8001", "0x8003", "0x8005", "0x0003", "dp_query", "DP_QUERY", "DP", "dp", "report", "REPORT")

#: Actions in structured queries, and the words of open questions with what these ask for.
ACTIONS = ("report", "query", "sync", "get", "set")
ACTION_SYNONYMS = ("report", "query", "同步", "查询", "上报")
OPEN_WORDS = ("怎么办", "如何", "怎么", "为什么", "什么时候")
OPEN_ACTIONS = ("策略", "建议", "处理", "解决", "方案", "原因", "时间点")

#: Question words by type, in order of trial.
QUESTION_TYPES = (
    ("how", ("如何", "怎么", "怎样", "方法", "步骤", "实现", "生成")),
    ("when", ("什么时候", "何时", "什么情况", "条件", "场景", "情况下")),
    ("what", ("什么", "哪个", "哪些")),
    ("why", ("为什么", "原因")),
)

#: Words of the coarse categories, in order of ties.
COARSE = (
    ("protocol", ("BLE", "蓝牙", "配对", "绑定", "pair", "bond", "advertis", "scan", "HID", "OTA", "DFU", "RS485", "CAN", "MQTT", "协议", "命令", "上报", "DP", "数据点", "物模型", "datapoint", "frame", "帧", "CRC", "校验", "骑行", "行程", "轨迹", "记录", "log")),
    ("log", ("log", "日志", "error", "错误", "fault", "故障", "warn", "警告", "exception", "异常", "crash", "崩溃", "dump", "trace", "调试")),
    ("c_code", ("struct", "function", "enum", "macro", "typedef", "define", "变量", "函数", "头文件", "include", "source", "impl", "implementation")),
)
#: Terms added to a query of a category that lacks them.
SEARCH_TERMS = {"protocol": ("BLE", "protocol", "命令", "上报", "DP", "RS485", "CAN"), "c_code": ("struct", "function", "enum", "function")}

#: Colloquial words and their terms, in order.
COLLOQUIAL = {
    "那玩意": "IoT设备",
    "那个": "设备",
    "玩意": "设备",
    "车子": "车辆",
    "车车": "车辆",
    "跌了": "净值回撤",
    "不行": "故障/异常",
    "怎么搞": "处理方法",
    "咋办": "解决方案",
    "有啥": "有哪些",
    "那货": "设备",
    "东东": "设备",
    "最近": "近期",
    "蓝牙连接": "BLE连接",
    "蓝牙配对": "BLE配对绑定",
    "蓝牙广播": "BLE广播",
    "蓝牙协议": "BLE协议",
    "can协议": "CAN协议",
    "485协议": "RS485协议",
    "数据点": "DP数据点",
    "功能点": "DP数据点",
    "升级": "OTA升级",
    "固件升级": "OTA升级",
    "加密": "安全加密",
    "校验": "CRC校验",
}
#: Pronouns and what they stand for, in order.
PRONOUNS = {"它": "设备", "他": "设备", "她": "设备", "这个": "该", "那个": "该", "这些": "这些", "那些": "那些"}
#: Question words and the action words put in their place, in order.
INTENT_ACTIONS = {
    "怎么办": ["策略", "建议", "处理", "解决", "方案"],
    "如何": ["方法", "步骤", "实现", "流程"],
    "怎么": ["方式", "方法", "步骤"],
    "为什么": ["原因", "原理"],
    "什么时候": ["时间点", "时机", "条件"],
    "上报": ["上报机制", "上报格式", "上报流程"],
    "查询": ["查询指令", "查询流程"],
    "下发": ["下发指令", "下发格式"],
    "绑定": ["配对绑定流程"],
    "升级": ["OTA升级流程"],
}
#: Which codes a mention of function codes means, by the first of these words that occurs.
CODE_HINTS = (("查询", "功能码0x0000或0x0003"), ("上报", "功能码0x8001或0x8002"), ("下发", "功能码0x0002"), ("配对", "功能码0x0001"), ("升级", "功能码0x000C-0x001C"))
#: Further queries about a protocol, by the words that name it.
PROTOCOL_QUERIES = ((("ble", "蓝牙"), ("BLE协议格式", "BLE功能码定义", "BLE数据上报")), (("can",), ("CAN协议格式", "CAN PGN定义", "CAN指令下发")), (("485", "rs485"), ("RS485通信格式", "RS485 DP表", "RS485功能码")))

#: Functions that need no definition in a file.
BUILTINS = (
    "printf", "scanf", "malloc", "free", "memcpy", "memset", "strlen",
    "strcpy", "strncpy", "strcmp", "memcmp", "memmove", "sprintf",
    "snprintf", "atoi", "atof", "strtol", "strdup", "calloc",
    "realloc", "exit", "abort", "assert", "sizeof", "offsetof",
    "vsprintf", "vprintf", "sscanf", "strcat", "strncat", "memchr",
    "localtime", "gmtime", "time", "srand", "rand", "xQueueSendToBack",
    "xTaskGetTickCount", "VL_LOG_DEBUG", "VL_LOG_ERROR", "VL_LOG_HEXDUMP_DEBUG",
)

#: Modules and the words that name them, in order of trial.
MODULES = (
    ("OTA", "ota|upgrade|dfu|bootloader|固件|升级"),
    ("BLE", "ble|bluetooth|hid|蓝牙|配对|绑定"),
    ("CAN", "can|canbus|总线"),
    ("RS485", "rs485|uart|串口"),
    ("IoT", "iot|mqtt|网络|通信"),
    ("BMS", "bms|电池|充电"),
    ("Sensor", "sensor|传感器|加速度|陀螺仪"),
    ("Display", "display|lcd|屏幕|仪表|显示"),
    ("Storage", "storage|sd|eeprom|flash|存储"),
)

#: Subsystems and their contexts by a part of the path, in order of trial.
SUBSYSTEMS = (
    ("gil", "gil/gps", "GPS定位/GNSS卫星定位状态"),
    ("gnss", "gil/gps", "GPS定位/GNSS卫星定位状态"),
    ("cil", "cil/ble", "BLE蓝牙通信/CIL适配器"),
    ("btdm", "cil/ble", "BLE蓝牙通信/BTDMSpliter"),
    ("ble", "cil/ble", "BLE蓝牙通信"),
    ("bt", "cil/ble", "BLE蓝牙通信"),
    ("btstack", "cil/ble", "BLE蓝牙通信/BTstack"),
    ("hci", "cil/ble", "BLE蓝牙通信/HCI层"),
    ("l2cap", "cil/ble", "BLE蓝牙通信/L2CAP层"),
    ("rfcomm", "cil/ble", "BLE蓝牙通信/RFCOMM"),
    ("sdp", "cil/ble", "BLE蓝牙通信/SDP服务发现"),
    ("can", "can/vehicle", "CAN总线/整车通信"),
    ("vehicle", "can/vehicle", "整车控制/Vehicle"),
    ("atdev", "atdev/uart", "AT设备/UART通信"),
    ("driver", "atdev/uart", "BSP驱动/UART通信"),
    ("bsp", "atdev/uart", "BSP驱动/外设驱动"),
    ("display", "atdev/uart", "显示驱动/Display"),
    ("touchpad", "atdev/uart", "触控驱动/Touchpad"),
    ("flash", "atdev/uart", "存储驱动/Flash"),
    ("lwip", "atdev/uart", "网络协议栈/LwIP"),
    ("mos", "mos/ota", "MOS升级/固件管理"),
    ("ota", "mos/ota", "MOS升级/OTA更新"),
    ("apptools", "apptools/app", "应用工具层"),
    ("common", "apptools/app", "公共代码/Common"),
    ("proj", "apptools/app", "项目工程/Project"),
    ("task_statistic", "task_statistic/metric", "任务统计/性能指标"),
    ("modules", "apptools/app", "应用模块/Modules"),
)
UNKNOWN_SUBSYSTEM = ("unknown", "未分类代码")
