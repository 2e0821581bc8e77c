"""Fixed dimension tables of the report catalogue and of chunk and entity classes."""

# Sectors and industry groups of the catalogue.
SECTORS = ["Energy", "Materials", "Industrials", "Consumer Discretionary", "Consumer Staples", "Health Care", "Financials", "Information Technology", "Communication Services", "Utilities", "Real Estate"]
INDUSTRY_GROUPS = [
    "Energy",
    "Materials",
    "Capital Goods",
    "Commercial & Professional Services",
    "Transportation",
    "Automobiles & Components",
    "Consumer Durables & Apparel",
    "Consumer Services",
    "Retailing",
    "Consumer Discretionary Distribution & Retail",
    "Consumer Staples Distribution & Retail",
    "Food & Staples Retailing",
    "Food, Beverage & Tobacco",
    "Household & Personal Products",
    "Health Care Equipment & Services",
    "Pharmaceuticals, Biotechnology & Life Sciences",
    "Banks",
    "Financial Services",
    "Insurance",
    "Software & Services",
    "Technology Hardware & Equipment",
    "Semiconductors & Semiconductor Equipment",
    "Telecommunication Services",
    "Media & Entertainment",
    "Utilities",
    "Real Estate",
]

# Source industry to (sector, industry group), and the override by company.
INDUSTRY_TO_GROUP = {
    "Advertising & Marketing": ("Communication Services", "Media & Entertainment"),
    "Aerospace & Defence": ("Industrials", "Capital Goods"),
    "Agricultural Products": ("Consumer Staples", "Food, Beverage & Tobacco"),
    "Air Freight & Logistics": ("Industrials", "Transportation"),
    "Airlines": ("Industrials", "Transportation"),
    "Alcoholic Beverages": ("Consumer Staples", "Food, Beverage & Tobacco"),
    "Apparel, Accessories & Footwear": ("Consumer Discretionary", "Consumer Durables & Apparel"),
    "Appliance Manufacturing": ("Consumer Discretionary", "Consumer Durables & Apparel"),
    "Asset Management & Custody Activities": ("Financials", "Financial Services"),
    "Auto Parts": ("Consumer Discretionary", "Automobiles & Components"),
    "Automobiles": ("Consumer Discretionary", "Automobiles & Components"),
    "Biotechnology & Pharmaceuticals": ("Health Care", "Pharmaceuticals, Biotechnology & Life Sciences"),
    "Building Products & Furnishings": ("Industrials", "Capital Goods"),
    "Car Rental & Leasing": ("Industrials", "Transportation"),
    "Casinos & Gaming": ("Consumer Discretionary", "Consumer Services"),
    "Chemicals": ("Materials", "Materials"),
    "Coal Operations": ("Energy", "Energy"),
    "Commercial Banks": ("Financials", "Banks"),
    "Construction Materials": ("Materials", "Materials"),
    "Consumer Finance": ("Financials", "Financial Services"),
    "Containers & Packaging": ("Materials", "Materials"),
    "Drug Retailers": ("Consumer Staples", "Consumer Staples Distribution & Retail"),
    "E-Commerce": ("Consumer Discretionary", "Consumer Discretionary Distribution & Retail"),
    "E-commerce": ("Consumer Discretionary", "Consumer Discretionary Distribution & Retail"),
    "Electric Utilities & Power Generators": ("Utilities", "Utilities"),
    "Electrical & Electronic Equipment": ("Industrials", "Capital Goods"),
    "Electronic Manufacturing Services & Original Design Manufacturing": ("Information Technology", "Technology Hardware & Equipment"),
    "Engineering & Construction Services": ("Industrials", "Capital Goods"),
    "Food Retailers & Distributors": ("Consumer Staples", "Consumer Staples Distribution & Retail"),
    "Forestry Management": ("Materials", "Materials"),
    "Fuel Cells & Industrial Batteries": ("Industrials", "Capital Goods"),
    "Gas Utilities & Distributors": ("Utilities", "Utilities"),
    "Hardware": ("Information Technology", "Technology Hardware & Equipment"),
    "Health Care Delivery": ("Health Care", "Health Care Equipment & Services"),
    "Health Care Distributors": ("Health Care", "Health Care Equipment & Services"),
    "Home Builders": ("Consumer Discretionary", "Consumer Durables & Apparel"),
    "Hotels & Lodging": ("Consumer Discretionary", "Consumer Services"),
    "Household & Personal Products": ("Consumer Staples", "Household & Personal Products"),
    "Industrial Machinery & Goods": ("Industrials", "Capital Goods"),
    "Insurance": ("Financials", "Insurance"),
    "Internet Media & Services": ("Communication Services", "Media & Entertainment"),
    "Investment Banking & Brokerage": ("Financials", "Financial Services"),
    "Iron & Steel Producers": ("Materials", "Materials"),
    "Leisure Facilities": ("Consumer Discretionary", "Consumer Services"),
    "Marine Transportation": ("Industrials", "Transportation"),
    "Meat, Poultry & Dairy": ("Consumer Staples", "Food, Beverage & Tobacco"),
    "Media & Entertainment": ("Communication Services", "Media & Entertainment"),
    "Medical Equipment & Supplies": ("Health Care", "Health Care Equipment & Services"),
    "Metals & Mining": ("Materials", "Materials"),
    "Multiline and Specialty Retailers & Distributors": ("Consumer Discretionary", "Consumer Discretionary Distribution & Retail"),
    "Non-Alcoholic Beverages": ("Consumer Staples", "Food, Beverage & Tobacco"),
    "Oil & Gas - Exploration & Production": ("Energy", "Energy"),
    "Oil & Gas - Midstream": ("Energy", "Energy"),
    "Oil & Gas - Refining & Marketing": ("Energy", "Energy"),
    "Oil & Gas - Services": ("Energy", "Energy"),
    "Processed Foods": ("Consumer Staples", "Food, Beverage & Tobacco"),
    "Professional & Commercial Services": ("Industrials", "Commercial & Professional Services"),
    "Pulp & Paper Products": ("Materials", "Materials"),
    "Rail Transportation": ("Industrials", "Transportation"),
    "Real Estate": ("Real Estate", "Real Estate"),
    "Real Estate Services": ("Real Estate", "Real Estate"),
    "Restaurants": ("Consumer Discretionary", "Consumer Services"),
    "Road Transportation": ("Industrials", "Transportation"),
    "Security & Commodity Exchange": ("Financials", "Financial Services"),
    "Semiconductors": ("Information Technology", "Semiconductors & Semiconductor Equipment"),
    "Software & IT Services": ("Information Technology", "Software & Services"),
    "Solar Technology & Project Developers": ("Industrials", "Capital Goods"),
    "Telecommunication Services": ("Communication Services", "Telecommunication Services"),
    "Tobacco": ("Consumer Staples", "Food, Beverage & Tobacco"),
    "Toys & Sporting Goods": ("Consumer Discretionary", "Consumer Durables & Apparel"),
    "Waste Management": ("Industrials", "Commercial & Professional Services"),
    "Water Utilities & Services": ("Utilities", "Utilities"),
    "Wind Technology & Project Developers": ("Industrials", "Capital Goods"),
}
COMPANY_TO_GROUP = {"Adyen": ("Financials", "Financial Services")}

# Chunk category to pillar (None: not routed), issue to pillar, entity class to pillar, issue to entity classes.
CATEGORY_TO_PILLAR = {
    "Climate Change": "E", "Natural Capital": "E", "Pollution & Waste": "E", "Human Capital": "S", "Product Liability": "S", "Community Relations": "S",
    "Corporate Governance": "G", "Business Ethics & Values": "G", "Non-ESG": None,
}
ISSUE_TO_PILLAR = {
    "Business_Ethics": "G",
    "Data_Security": "S",
    "Access_And_Affordability": "S",
    "Business_Model_Resilience": "G",
    "Competitive_Behavior": "G",
    "Critical_Incident_Risk_Management": "G",
    "Customer_Welfare": "S",
    "Director_Removal": "G",
    "Employee_Engagement_Inclusion_And_Diversity": "S",
    "Employee_Health_And_Safety": "S",
    "Human_Rights_And_Community_Relations": "S",
    "Labor_Practices": "S",
    "Management_Of_Legal_And_Regulatory_Framework": "G",
    "Physical_Impacts_Of_Climate_Change": "E",
    "Product_Quality_And_Safety": "S",
    "Product_Design_And_Lifecycle_Management": "E",
    "Selling_Practices_And_Product_Labeling": "S",
    "Supply_Chain_Management": "S",
    "Systemic_Risk_Management": "G",
    "Waste_And_Hazardous_Materials_Management": "E",
    "Water_And_Wastewater_Management": "E",
    "Air_Quality": "E",
    "Customer_Privacy": "S",
    "Ecological_Impacts": "E",
    "Energy_Management": "E",
    "GHG_Emissions": "E",
}
ENTITY_TO_PILLAR = {
    "ghg_emissions": "E", "climate_target": "E", "energy": "E", "water": "E", "waste": "E", "biodiversity": "E",
    "social_metric": "S", "governance_policy": "G", "financial_esg": "G", "regulatory": "G",
}
ISSUE_TO_ENTITIES = {
    "GHG_Emissions": ["ghg_emissions"],
    "Energy_Management": ["energy"],
    "Water_And_Wastewater_Management": ["water"],
    "Waste_And_Hazardous_Materials_Management": ["waste"],
    "Ecological_Impacts": ["biodiversity"],
    "Air_Quality": ["waste"],
    "Physical_Impacts_Of_Climate_Change": ["ghg_emissions", "climate_target", "biodiversity"],
    "Product_Design_And_Lifecycle_Management": ["waste", "energy"],
    "Business_Ethics": ["governance_policy"],
    "Data_Security": ["governance_policy"],
    "Customer_Privacy": ["governance_policy"],
    "Competitive_Behavior": ["governance_policy"],
    "Director_Removal": ["governance_policy"],
    "Critical_Incident_Risk_Management": ["governance_policy"],
    "Systemic_Risk_Management": ["governance_policy"],
    "Management_Of_Legal_And_Regulatory_Framework": ["regulatory"],
    "Business_Model_Resilience": ["financial_esg", "governance_policy"],
    "Supply_Chain_Management": ["social_metric", "governance_policy"],
    "Labor_Practices": ["social_metric"],
    "Employee_Health_And_Safety": ["social_metric"],
    "Employee_Engagement_Inclusion_And_Diversity": ["social_metric"],
    "Human_Rights_And_Community_Relations": ["social_metric"],
    "Access_And_Affordability": ["social_metric"],
    "Customer_Welfare": ["social_metric"],
    "Selling_Practices_And_Product_Labeling": ["social_metric", "governance_policy"],
    "Product_Quality_And_Safety": ["social_metric"],
}

# Display categories of the rules, in order, with the label of each rule.
DISPLAY_CATEGORIES = {
    "Frameworks & Standards": {"framework_esrs": "ESRS", "framework_csrd": "CSRD", "framework_gri": "GRI", "gri_content_index": "GRI Index", "framework_sasb": "SASB", "framework_tcfd": "TCFD", "framework_issb": "ISSB", "framework_eu_taxonomy": "EU Taxonomy", "framework_tnfd": "TNFD", "framework_cdp": "CDP", "framework_sdgs": "SDGs"},
    "Climate & Emissions": {"scope_1": "Scope 1", "scope_2": "Scope 2", "scope_3": "Scope 3", "scope3_categories": "Scope 3 categories", "scope2_method": "Location/Market-based", "ghg_protocol": "GHG Protocol", "emissions_numbers": "Emissions data", "emissions_intensity": "Emissions intensity", "climate_scenario": "Climate scenarios", "carbon_pricing": "Carbon pricing"},
    "Targets & Strategy": {"net_zero": "Net zero", "sbti": "SBTi", "paris_agreement": "Paris alignment", "transition_plan": "Transition plan", "quantitative_targets": "Quantitative targets", "interim_targets": "Interim targets", "target_progress": "Progress tracking"},
    "Environment": {"energy": "Energy", "renewable_energy": "Renewables", "water": "Water", "waste": "Waste", "biodiversity": "Biodiversity", "circular_economy": "Circular economy", "pollution": "Pollution"},
    "Social": {"workforce": "Workforce", "safety": "Health & Safety", "diversity": "Diversity & Inclusion", "human_rights": "Human rights", "training": "Training", "stakeholder_engagement": "Stakeholders", "health_wellbeing": "Wellbeing", "employee_turnover": "Employee turnover", "community_investment": "Community", "living_wage": "Living wage", "just_transition": "Just transition"},
    "Governance & Integrity": {"board_oversight": "Board oversight", "sustainability_committee": "Sustainability committee", "audit_committee": "Audit committee", "internal_control": "Internal control", "risk_management": "Risk management", "esg_remuneration": "ESG remuneration", "whistleblower": "Whistleblower", "anti_corruption": "Anti-corruption", "data_privacy": "Data privacy", "tax_transparency": "Tax transparency"},
    "Assurance": {"assurance_reasonable": "Reasonable assurance", "assurance_limited": "Limited assurance", "assurance_isae": "ISAE 3000/3410", "assurance_aa1000": "AA1000", "named_assurance_provider": "Named provider", "assurance_scope": "Assurance scope"},
    "Disclosure Quality": {"double_materiality": "Double materiality", "materiality_matrix": "Materiality matrix", "iro_analysis": "IRO analysis", "methodology": "Methodology", "boundary": "Reporting boundary", "data_quality": "Data quality", "forward_looking": "Forward-looking", "transition_plan": "Transition plan", "base_year": "Base year", "limitations": "Limitations", "restatement": "Restatement", "connectivity_financial": "Financial connectivity", "esrs_datapoints": "ESRS data points"},
}
# Categories of the evidence list, in order, with the label of each rule.
EVIDENCE_CATEGORIES = {
    "Frameworks": {"framework_esrs": "ESRS", "framework_csrd": "CSRD", "framework_eu_taxonomy": "EU Taxonomy", "framework_gri": "GRI", "gri_content_index": "GRI Content Index", "framework_tcfd": "TCFD", "framework_tnfd": "TNFD", "framework_sdgs": "SDGs"},
    "Materiality & Scope": {"double_materiality": "Double materiality", "materiality_matrix": "Materiality matrix", "iro_analysis": "IRO analysis", "value_chain": "Value chain"},
    "Emissions": {"scope_1": "Scope 1", "scope_2": "Scope 2", "scope_3": "Scope 3", "scope3_categories": "Scope 3 categories", "scope2_method": "Scope 2 methods", "ghg_protocol": "GHG Protocol", "emissions_numbers": "Emissions data", "emissions_intensity": "Emissions intensity"},
    "Targets & Strategy": {"net_zero": "Net zero", "sbti": "SBTi", "transition_plan": "Transition plan", "paris_agreement": "Paris Agreement", "quantitative_targets": "Quantitative targets", "interim_targets": "Interim targets", "target_progress": "Target progress"},
    "Climate & Environment": {"climate_scenario": "Climate scenarios", "carbon_pricing": "Carbon pricing", "renewable_energy": "Renewable energy", "biodiversity": "Biodiversity", "circular_economy": "Circular economy", "pollution": "Pollution", "energy": "Energy", "water": "Water", "waste": "Waste"},
    "Social": {"human_rights": "Human rights", "stakeholder_engagement": "Stakeholder engagement", "training": "Training", "health_wellbeing": "Health & Wellbeing", "employee_turnover": "Employee turnover", "diversity": "Diversity", "workforce": "Workforce", "safety": "Safety"},
    "Assurance": {"assurance_any": "Assurance", "named_assurance_provider": "Named provider", "assurance_scope": "Assurance scope"},
    "Quality & Controls": {"methodology": "Methodology", "boundary": "Boundary", "data_quality": "Data quality", "forward_looking": "Forward-looking", "limitations": "Limitations", "connectivity_financial": "Financial connectivity", "esrs_datapoints": "ESRS data points"},
    "Governance": {"esg_remuneration": "ESG remuneration", "whistleblower": "Whistleblower", "anti_corruption": "Anti-corruption", "board_oversight": "Board oversight", "sustainability_committee": "Sustainability committee"},
}
