"""Expected schemas of the input and result tables."""

HOURLY = """
    country STRING, dateTime TIMESTAMP_NTZ,
    demand DOUBLE, windOnshore DOUBLE, windOffshore DOUBLE, solar DOUBLE
"""

CAPACITY = """
    country STRING, year INT, windOnshore DOUBLE, windOffshore DOUBLE, solar DOUBLE
"""

RESULTS = """
    nuclear DOUBLE, renewable DOUBLE, netStorage DOUBLE, demand DOUBLE,
    energyNotServed DOUBLE, storageLevel DOUBLE, curtailNuclear DOUBLE, curtailRenewable DOUBLE,
    share_generation DECIMAL(12,8), share_renewable DECIMAL(12,8), share_storage DECIMAL(12,8),
    costCurtailNuclear DOUBLE, costCurtailRenewable DOUBLE, date TIMESTAMP_NTZ
"""

COMPARISON = """
    model STRING, scenario STRING, variable STRING, technology STRING, year STRING, value DOUBLE
"""
