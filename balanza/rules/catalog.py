"""Code catalogues."""

from __future__ import annotations

# Bureau credit type codes.
CREDIT_TYPES = {
    "3231": "Cartera de Arrendamiento Financiero Vigente",
    "1314": "No Disponible",
    "1323": "Créditos Reestructurados",
    "6291": "Fianzas",
    "1310": "Préstamos para la vivienda",
    "1327": "Arrendamiento Financiero Sindicado",
    "1300": "Cartera de arrendamiento Puro y créditos",
    "1308": "Créditos Refaccionarios",
    "6103": "Adeudos por Aval",
    "3012": "Cartera de Factoraje sin Recursos",
    "1306": "Préstamos con garantía de unidades industriales",
    "3230": "Anticipo a Clientes Por Promesa de Factoraje",
    "1317": "Créditos venidos a menos aseg. Gtias. Adicionales",
    "3011": "Cartera de Factoraje con Recursos",
    "6280": "Línea de Crédito",
    "1316": "Otros adeudos vencidos",
    "1320": "Cartera de Arrendamiento Financiero Vigente",
    "1321": "Cartera de Arrendamiento Financiero Sindicado con Aportación",
    "1324": "Créditos Renovados",
    "1322": "Crédito de Arrendamiento",
    "1311": "Otros créditos con garantía inmobiliaria",
    "1340": "Cartera descontada con Inst. de Crédito",
    "6270": "Crédito Automotriz",
    "1303": "Con colateral",
    "6290": "Seguros",
    "6228": "Fideicomisos Prog. apoyo crediticio planta productiva Nac.",
    "1341": "Redescuento otra cartera descontada",
    "6230": "Fideicomisos Prog. apoyo deudores vivienda UDIS",
    "1304": "Prendario",
    "1301": "Descuentos",
    "6240": "Aba Pasem II",
    "1350": "Prestamos con Fideicomisos de Garantía",
    "6250": "Tarjeta de Servicio",
    "1342": "Redescuento cartera reestructurada (Fidec.)",
    "1302": "Quirografario",
    "1307": "Créditos de habilitación o avío",
    "1380": "Tarjeta de Crédito empresarial / Corporativa",
    "6229": "Fideicomisos Prog. apoyo crediticio Estados y Municipios",
    "6105": "Cartas de Créditos No Dispuestas",
    "2303": "Cartas de Crédito",
    "1309": "Prestamos Inmobil Emp Prod de Bienes o Servicios",
    "6292": "Fondos y Fideicomisos",
    "6260": "Crédito Fiscal",
    "1305": "Créditos simples y créditos en cuenta corriente",
}
CURRENCIES = {"001": "MXN"}
BLACKLIST_STATUS = {
    "presumed": "Presunto",
    "dismissed": "Desvirtuado",
    "definitive": "Definitivo",
    "favorable": "Favorable",
}
RED_FLAG_STATUS = ("definitive", "presumed")

# The past-due age brackets of a bureau line.
PAST_DUE_BUCKETS = ("1_29", "30_59", "60_89", "90_119", "120_179", "180_plus")

# Pay-history codes counted one by one, after the two-letter code LC.
MOP_CODES = ("1", "2", "3", "4", "5", "6", "7", "9", "0", "U", "-")
