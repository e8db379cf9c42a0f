"""The canonical tables of a city model and the fixed vocabularies."""

from __future__ import annotations

#: Fixed values of the exchange format.
LODS = tuple(f"{a}" for a in range(4)) + tuple(f"{a}.{b}" for a in range(4) for b in range(4))
GEOMETRY_TYPES = {"MultiPoint": 1, "MultiLineString": 2, "MultiSurface": 3, "CompositeSurface": 3, "Solid": 4, "MultiSolid": 5, "CompositeSolid": 5, "GeometryInstance": 0}
OBJECT_TYPES = (
    "Bridge", "BridgePart", "BridgeInstallation", "BridgeConstructiveElement", "BridgeRoom", "BridgeFurniture", "Building", "BuildingPart",
    "BuildingInstallation", "BuildingConstructiveElement", "BuildingFurniture", "BuildingStorey", "BuildingRoom", "BuildingUnit", "CityFurniture",
    "CityObjectGroup", "GenericCityObject", "LandUse", "OtherConstruction", "PlantCover", "SolitaryVegetationObject", "TINRelief", "Road", "Railway",
    "Waterway", "TransportSquare", "Tunnel", "TunnelPart", "TunnelInstallation", "TunnelConstructiveElement", "TunnelHollowSpace", "TunnelFurniture",
    "WaterBody",
)
SEMANTIC_TYPES = (
    "RoofSurface", "GroundSurface", "WallSurface", "ClosureSurface", "OuterCeilingSurface", "OuterFloorSurface", "Window", "Door",
    "InteriorWallSurface", "CeilingSurface", "FloorSurface", "WaterSurface", "WaterGroundSurface", "WaterClosureSurface", "TrafficArea",
    "AuxiliaryTrafficArea", "TransportationMarking", "TransportationHole",
)
WRAP_MODES = ("wrap", "mirror", "clamp", "border", "none")
TEXTURE_TYPES = ("unknown", "specific", "typical")
IMAGE_TYPES = ("PNG", "JPG")
CONTACT_TYPES = ("individual", "organization")
CONTACT_ROLES = (
    "author", "co-author", "processor", "pointOfContact", "owner", "user", "distributor", "originator", "custodian", "resourceProvider", "rightsHolder", "sponsor",
    "principalInvestigator", "stakeholder", "publisher",
)
VERSIONS = ("2.0", "2.0.0", "2.0.1")

_OFFSETS = "vertex_indices array<int>, line_offsets array<int>, ring_offsets array<int>, surface_offsets array<int>, shell_offsets array<int>, solid_offsets array<int>"
_TEXTURE = "surface_ordinal int, ring_ordinal int, theme string, texture_id bigint, uv_indices array<bigint>"

#: Table -> columns, in the order in which tables are written and read.
TABLES = {
    "metadata": "citymodel_id string, format_version string, citymodel_kind string, feature_root_id string, identifier string, title string, reference_system string, "
    "geographical_extent array<double>, reference_date string, default_material_theme string, default_texture_theme string, point_of_contact string, root_extra string, metadata_extra string",
    "extensions": "extension_name string, uri string, version string",
    "vertices": "vertex_id bigint, x double, y double, z double",
    "template_vertices": "template_vertex_id bigint, x double, y double, z double",
    "texture_vertices": "uv_id bigint, u float, v float",
    "semantics": "semantic_id bigint, semantic_type string, parent_semantic_id bigint, attributes string",
    "semantic_children": "parent_semantic_id bigint, child_ordinal int, child_semantic_id bigint",
    "materials": "material_id bigint, name string, ambient_intensity double, diffuse_color array<double>, emissive_color array<double>, specular_color array<double>, shininess double, transparency double, is_smooth boolean",
    "textures": "texture_id bigint, image_uri string, image_type string, wrap_mode string, texture_type string, border_color array<double>",
    "template_geometry_boundaries": f"template_geometry_id bigint, {_OFFSETS}",
    "template_geometry_semantics": "template_geometry_id bigint, primitive_type string, primitive_ordinal int, semantic_id bigint",
    "template_geometry_materials": "template_geometry_id bigint, primitive_type string, primitive_ordinal int, theme string, material_id bigint",
    "template_geometry_ring_textures": f"template_geometry_id bigint, {_TEXTURE}",
    "template_geometries": "template_geometry_id bigint, geometry_type string, lod string, extra string",
    "geometry_boundaries": f"geometry_id bigint, {_OFFSETS}",
    "geometry_surface_semantics": "geometry_id bigint, surface_ordinal int, semantic_id bigint",
    "geometry_point_semantics": "geometry_id bigint, point_ordinal int, semantic_id bigint",
    "geometry_linestring_semantics": "geometry_id bigint, linestring_ordinal int, semantic_id bigint",
    "geometry_surface_materials": "geometry_id bigint, surface_ordinal int, theme string, material_id bigint",
    "geometry_ring_textures": f"geometry_id bigint, {_TEXTURE}",
    "geometry_instances": "geometry_id bigint, cityobject_ix bigint, geometry_ordinal int, lod string, template_geometry_id bigint, reference_point_vertex_id bigint, transform_matrix array<double>, extra string",
    "geometries": "geometry_id bigint, cityobject_ix bigint, geometry_ordinal int, geometry_type string, lod string, extra string",
    "cityobjects": "cityobject_id string, cityobject_ix bigint, object_type string, geographical_extent array<double>, attributes string, extra string",
    "cityobject_children": "parent_cityobject_ix bigint, child_ordinal int, child_cityobject_ix bigint",
}
REQUIRED = ("metadata", "vertices", "cityobjects", "geometries", "geometry_boundaries")
