"""Regions of four western states by county. All tables here are fixed values.

Rows are (state, counties, region) in order of priority; the first row that names a county wins.
"""

from __future__ import annotations

WEST_COAST_STATES = [4, 6, 41, 53]

REGIONS = [
    (4, [30, 70, 90, 110, 130, 190, 210, 230, 250, 270], "Southern AZ"),
    (4, [10, 50, 150, 170], "Northern AZ"),
    (6, [30, 50, 90, 170, 270, 430, 510], "South Sierras CA"),
    (6, [150, 210, 230, 350, 490, 630, 890, 930, 1030, 1050], "Northern CA"),
    (6, [330, 410, 450, 550, 970], "North Coast CA"),
    (6, [570, 910, 1150], "Yuba CA"),
    (6, [10], "Alameda, CA"),
    (6, [70], "Butte, CA"),
    (6, [110], "Colusa, CA"),
    (6, [130], "Contra Costa, CA"),
    (6, [190], "Fresno, CA"),
    (6, [250], "Imperial, CA"),
    (6, [290], "Kern, CA"),
    (6, [310], "Kings, CA"),
    (6, [370], "Los Angeles, CA"),
    (6, [390], "Madera, CA"),
    (6, [470], "Merced, CA"),
    (6, [530], "Monterey, CA"),
    (6, [590], "Orange, CA"),
    (6, [610], "Placer, CA"),
    (6, [650], "Riverside, CA"),
    (6, [670], "Sacramento, CA"),
    (6, [690], "San Benito, CA"),
    (6, [710], "San Bernardino, CA"),
    (6, [730], "San Diego, CA"),
    (6, [750], "San Francisco, CA"),
    (6, [770], "San Joaquin, CA"),
    (6, [790], "San Luis Obispo, CA"),
    (6, [810], "San Mateo, CA"),
    (6, [830], "Santa Barbara, CA"),
    (6, [850], "Santa Clara, CA"),
    (6, [870], "Santa Cruz, CA"),
    (6, [950], "Solano, CA"),
    (6, [970], "Sonoma, CA"),
    (6, [990], "Stanislaus, CA"),
    (6, [1010], "Sutter, CA"),
    (6, [1070], "Tulare, CA"),
    (6, [1110], "Ventura, CA"),
    (6, [1130], "Yolo, CA"),
    (41, [30, 70, 90, 410, 530, 570, 710], "Northwest OR"),
    (41, [10, 130, 210, 230, 250, 370, 450, 490, 550, 590, 610, 630, 690], "Eastern Oregon"),
    (41, [110, 150, 190, 330], "Southern OR"),
    (41, [170, 310, 350, 650], "Fall Line OR"),
    (41, [50], "Clackamas, OR"),
    (41, [270], "Hood River, OR"),
    (41, [470], "Marion, OR"),
    (41, [510], "Multnomah, OR"),
    (41, [670], "Washington, OR"),
    (53, [10, 30, 50, 130, 210, 230, 710, 750], "South East WA"),
    (53, [70, 170, 190, 250, 430, 470, 510, 650], "North East WA"),
    (53, [90, 290, 310, 550], "Clallam-Jefferson-Island-San-Juan, WA"),
    (53, [570, 610, 730], "Skagit-Snohomish-Whatcom, WA"),
    (53, [390, 590], "Skamania-Klikatat, WA"),
    (53, [410, 450, 670], "Lewis-Mason-Thurston, WA"),
    (53, [270, 490, 690], "Grays-Harbor-Pacific-Wahkiakum, WA"),
    (53, [110], "Clark, WA"),
    (53, [150], "Cowlitz, WA"),
    (53, [330], "King, WA"),
    (53, [350], "Kitsap, WA"),
    (53, [530], "Pierce, WA"),
    (53, [630], "Spokane, WA"),
    (53, [770], "Yakima, WA"),
]

# Regions outside the zone in the states that lie in it in part; one state lies in it as a whole.
OUTSIDE_ZONE = ["Northern AZ", "Eastern Oregon", "South East WA", "North East WA", "Spokane, WA"]
WHOLE_STATE_IN_ZONE = [6]
