"""Models, scenarios and category maps of the model comparison."""

from __future__ import annotations

Map = dict[str, list[str]]

# Model ids with their names, the kind of their typical days and these days' dates, and
# scenario names.
MODELS = {"secmod": "SecMod", "seseth": "SES-ETH", "stem": "STEM", "zengarden": "ZEN-Garden"}
TYPICAL_DAYS = {
    "secmod": ("Typical day", "01.07.2050", "Typical day", "01.02.2050"),
    "seseth": ("Typical day", "01.07.2050", "Typical day", "01.02.2050"),
    "stem": ("Week day", "01.07.2050", "Week day", "01.02.2050"),
    "zengarden": ("Week day", "01.07.2050", "Week day", "01.02.2050"),
}
SCENARIOS = [
    "abroad-res-full",
    "abroad-res-lim",
    "domestic-res-full",
    "domestic-res-lim",
    "abroad-nores-full",
    "abroad-nores-lim",
    "domestic-nores-full",
    "domestic-nores-lim",
]

# Categories with their technology, use or fuel codes.
SUPPLY: Map = {
    "Hydro": ["hydro_dam", "hydro_ror"],
    "Nuclear": ["nuclear"],
    "Solar": ["spv"],
    "Wind": ["wind"],
    "Geothermal": ["geothermal_pp"],
    "Methane": ["methane_pp", "fuel_cell_methane"],
    "Hydrogen": ["hydrogen_pp", "fuel_cell_h2"],
    "Liquids": ["liquids_pp"],
    "Waste": ["waste_pp"],
    "Wood": ["wood_pp"],
    "Storage": ["battery_out", "phs_out"],
    "Imports": ["imports"],
}
USE: Map = {
    "Base": ["elec_appliances"],
    "Trains": ["passenger_rail", "freight_rail"],
    "Road transport": ["road_public", "road_private", "truck", "ldv"],
    "Space heating": [
        "space_heating_boiler_electrode",
        "space_heating_heater_elec",
        "space_heating_heat_pump",
    ],
    "Process heat": [
        "process_heat_boiler_electrode",
        "process_heat_heater_elec",
        "process_heat_heat_pump",
    ],
    "Power to liquids": ["power_to_liquid"],
    "Electrolysis": ["electrolysis"],
    "CCS": ["dac"],
    "Storage": ["battery_in", "phs_in"],
    "Exports": ["exports"],
    "Losses": ["grid_losses"],
}
HYDROGEN_SUPPLY: Map = {
    "Electrolysis": ["electrolyser"],
    "Steam reforming": ["steam_reforming"],
    "Gasification": ["wood_gasification_h2", "waste_gasification_h2"],
    "Pyrolysis": ["methane_pyrolysis"],
    "Imports": ["imports"],
}
HYDROGEN_USE: Map = {
    "Electricity": ["hydrogen_pp", "fuel_cell_h2"],
    "Freight": ["truck", "ldv"],
    "Passengers": ["passenger_road_public", "passenger_road_private"],
    "Space heating": ["space_heating"],
    "Process heat": ["process_heat"],
    "Fuel synthesis": ["fuel_synthesis"],
    "Storage": ["storage"],
    "Exports": ["exports"],
}
METHANE_SUPPLY: Map = {
    "Anaerobic digestion": ["anaerobic_digestion"],
    "Gasification": ["wood_gasification_methane", "waste_gasification_methane"],
    "Methanation": ["methanation"],
    "Imports": ["imports_methane", "imports_gas"],
}
LIQUIDS_SUPPLY: Map = {
    "Power-to-liquids": ["power_to_liquid"],
    "Liquefaction": ["wood_liquefaction", "waste_liquefaction"],
    "Imports": ["imports_diesel", "imports_biodiesel"],
}
SPACE_HEAT: Map = {
    "Heat pumps": ["heat_pump"],
    "Heaters": ["heater_elec", "boiler_electrode"],
    "Solar": ["solar_thermal"],
    "Geothermal": ["geothermal_heat"],
    "Methane": ["boiler_methane", "chp_methane"],
    "Hydrogen": ["boiler_h2", "chp_h2"],
    "Liquids": ["boiler_liquids", "chp_liquids"],
    "Waste": ["boiler_waste", "chp_waste"],
    "Wood": ["boiler_wood", "chp_wood"],
    "District Heating": ["district_heating"],
}
TRANSPORT: Map = {
    "Electricity": ["electricity"],
    "Liquids": ["oil", "liquids"],
    "Biogas": ["methane"],
    "Hydrogen": ["hydrogen"],
}
SUPPLY_NET: Map = {
    "Hydro": ["hydro_dam", "hydro_ror"],
    "Nuclear": ["nuclear"],
    "Solar": ["spv"],
    "Wind": ["wind"],
    "Geothermal": ["geothermal_pp"],
    "Methane": ["methane_pp", "fuel_cell_methane"],
    "Hydrogen": ["hydrogen_pp", "fuel_cell_h2"],
    "Liquids": ["liquids_pp"],
    "Waste": ["waste_pp"],
    "Wood": ["wood_pp"],
    "Storage": ["net_storage_out"],
    "Net-imports": ["net_imports"],
}
SUPPLY_SPREAD: Map = {
    "Hydro": ["hydro_dam", "hydro_ror"],
    "Nuc.": ["nuclear"],
    "Solar": ["spv"],
    "Wind": ["wind"],
    "Geoth.": ["geothermal_pp"],
    "Gas": ["methane_pp", "fuel_cell_methane"],
    "H2": ["hydrogen_pp", "fuel_cell_h2"],
    "Liquids": ["liquids_pp"],
    "Waste": ["waste_pp"],
    "Wood": ["wood_pp"],
}
USE_NET: Map = {
    "Base": ["elec_appliances"],
    "Trains": ["passenger_rail", "freight_rail"],
    "Road transport": ["road_public", "road_private", "truck", "ldv"],
    "Space heating": [
        "space_heating_boiler_electrode",
        "space_heating_heater_elec",
        "space_heating_heat_pump",
    ],
    "Process heat": ["process_heat_boiler_electrode", "process_heat_heater_elec", "process_heat_heat_pump"],
    "Power to liquids": ["power_to_liquid"],
    "Electrolysis": ["electrolysis"],
    "Others": ["dac", "data_centers"],
    "Storage": ["net_storage_in"],
    "Net-exports": ["net_exports"],
    "Losses": ["grid_losses", "storage_losses"],
}
USE_SPREAD: Map = {
    "Base": ["elec_appliances"],
    "Passenger": ["road_public", "road_private"],
    "Freight": ["truck", "ldv"],
    "Space\nheating": [
        "space_heating_boiler_electrode",
        "space_heating_heater_elec",
        "space_heating_heat_pump",
    ],
    "Process\nheat": ["process_heat_boiler_electrode", "process_heat_heater_elec", "process_heat_heat_pump"],
    "Electrolysis": ["electrolysis"],
}
METHANE_USE: Map = {
    "Electricity": ["elec_generation"],
    "Freight": ["truck", "ldv"],
    "Passengers": ["passenger_road_public", "passenger_road_private"],
    "Space heating": ["space_heating"],
    "Process heat": ["process_heat"],
    "Fuel syntheis": ["fuel_synthesis"],
    "Storage": ["storage"],
    "Exports": ["exports"],
}
LIQUIDS_USE: Map = {
    "Electricity": ["elec_generation"],
    "Freight": ["truck", "ldv"],
    "Passengers": ["passenger_road_public", "passenger_road_private"],
    "Space heating": ["space_heating"],
    "Process heat": ["process_heat"],
    "Fuel syntheis": ["fuel_synthesis"],
    "Storage": ["storage"],
    "Exports": ["exports"],
}
SPACE_HEAT_SPREAD: Map = {
    "Heat\npumps": ["heat_pump"],
    "Heaters": ["heater_elec", "boiler_electrode"],
    "Solar": ["solar_thermal"],
    "Geoth.": ["geothermal_heat"],
    "Gas": ["boiler_methane", "chp_methane"],
    "H2": ["boiler_h2", "chp_h2"],
    "Liquids": ["boiler_liquids", "chp_liquids"],
    "Waste": ["boiler_waste", "chp_waste"],
    "Wood": ["boiler_wood", "chp_wood"],
}
PROCESS_HEAT: Map = {
    "Heat pumps": ["heat_pump"],
    "Heaters": ["heater_elec", "boiler_electrode"],
    "Solar": ["solar_thermal"],
    "Geothermal": ["geothermal_heat"],
    "Methane": ["boiler_methane", "chp_methane"],
    "Hydrogen": ["boiler_h2", "chp_h2"],
    "Liquids": ["boiler_liquids", "chp_liquids"],
    "Waste": ["boiler_waste", "chp_waste"],
    "Wood": ["boiler_wood", "chp_wood"],
}
PROCESS_HEAT_SPREAD: Map = {
    "Heat\npumps": ["heat_pump"],
    "Heaters": ["heater_elec", "boiler_electrode"],
    "Solar": ["solar_thermal"],
    "Geoth.": ["geothermal_heat"],
    "Gas": ["boiler_methane", "chp_methane"],
    "H2": ["boiler_h2", "chp_h2"],
    "Liquid": ["boiler_liquids", "chp_liquids"],
    "Waste": ["boiler_waste", "chp_waste"],
    "Wood": ["boiler_wood", "chp_wood"],
}
TRANSPORT_SPREAD: Map = {
    "Electricity": ["electricity"],
    "Liquids": ["oil", "liquids"],
    "Biogas": ["methane"],
    "Hydrogen": ["hydrogen"],
}
